"""Fingerprints against a plain version, and their collision rate against generalised Jaccard similarity."""

import hashlib
import math
import random
from collections import Counter

import xxhash

from scopelens.llm import fingerprints

SIGN = 1 << 63


def hashed(*values):
    seed = 42
    for value in values:
        if value is None:
            continue
        raw = value if isinstance(value, bytes) else value[0].to_bytes(value[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return (seed ^ SIGN) - SIGN


def long(x):
    return (x, 8)


def weights(text):
    for end in fingerprints.ENDS:
        text = text.replace(f"{end} ", f"{end}\n")
    out = Counter()
    for phrase in text.split("\n"):
        out[hashed(phrase.encode())] += len(phrase) + 1
    return out


def samples(text):
    out = []
    for sample in range(fingerprints.SAMPLES):
        best = None
        for term, weight in weights(text).items():
            bits = hashed(long(term), (sample, 4)) % (1 << 64)
            u = [((bits >> shift) % (1 << width) + 0.5) / 2**width for shift, width in ((19, 9), (10, 9), (46, 18), (28, 18), (0, 10))]
            r, log_c, b = -math.log(u[0] * u[1]), math.log(-math.log(u[2] * u[3])), u[4]
            t = math.floor(math.log(weight) / r + b)
            folded = bits ^ bits >> 32
            found = (log_c - r * (t - b + 1), (folded ^ folded >> 16 ^ t) & 0xFFFF)
            best = found if best is None else min(best, found)
        out.append(best[1])
    return out


def alike(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def jaccard(a, b):
    x, y = weights(a), weights(b)
    return sum((x & y).values()) / sum((x | y).values())


def brute(rows):
    order = sorted(
        ((i is None, -(i or 0), hashed((text or "").encode(), (int(i is None), 4)), i, text or "") for i, text in rows), key=lambda row: row[:3]
    )
    out = []
    for k, (*_, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][-1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        own, changed, other = samples(text), samples(edited), samples(following)
        out.append(
            (-1 if i is None else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:04X}" for x in own), "".join(f"{x:04X}" for x in changed), alike(own, changed), alike(own, other))
        )
    return sorted(out)


def found(df):
    return sorted(tuple(-1 if x is None else x for x in row) for row in fingerprints.fingerprints(df).collect())


def test_equals_plain_version(documents, prose):
    rows = [(k, prose(5 + 3 * k, k % 9)) for k in range(24)]
    assert found(documents(*rows)) == brute(rows)


def test_defined_cases(documents, prose):
    rows = [
        (1, None),
        (2, ""),
        (3, " "),
        (4, "one"),
        (5, "Größe 😀 line\nanother\tline  end "),
        (6, prose(4000, 3)),
        (7, "a a a a a a"),
        (8, prose(30, 1)),
        (8, prose(30, 1)),  # repeated row
        (8, prose(30, 1)),
        (8, prose(31, 2)),  # another text of the same id
        (9, prose(30, 1)),
        (None, "no id"),
        (None, "no id"),
        (0, "id 0, like a null id in the key"),
        (-7, "below"),
    ]
    assert found(documents(*rows)) == brute(rows)
    assert found(documents()) == []
    assert found(documents((5, "only one"))) == brute([(5, "only one")])


def test_equal_texts_have_equal_fingerprints(documents, prose):
    out = fingerprints.fingerprints(documents((1, prose(50, 1)), (2, prose(50, 1)), (3, prose(50, 2)))).collect()
    prints = {row["doc_id"]: row["fingerprint"] for row in out}
    assert prints[1] == prints[2] != prints[3]
    assert {row["doc_id"]: row["near_next"] for row in out}[2] == 1.0


def test_collision_rate_is_generalised_jaccard_similarity(documents):
    source = random.Random(8)
    errors = []
    rows, pairs = [], []
    for k in range(0, 120, 2):
        # words of one pair only, so that the errors of pairs are independent
        words = [f"{k}" + "x" * source.randrange(9) + source.choice("abcdefg") for _ in range(60)]
        other = [w if source.random() < k / 120 else f"{k}{source.choice('abcdefg')}" for w in words]
        rows += [(k, "\n".join(words)), (k + 1, "\n".join(other))]
        pairs.append((k + 1, jaccard("\n".join(words), "\n".join(other))))
    near = {row["doc_id"]: row["near_next"] for row in fingerprints.fingerprints(documents(*rows)).collect()}
    for doc, exact in pairs:
        errors.append(near[doc] - exact)
    spread = math.sqrt(sum(x * (1 - x) for _, x in pairs) / len(pairs) / fingerprints.SAMPLES)
    assert abs(sum(errors) / len(errors)) < 3 * spread / math.sqrt(len(errors)) + 1e-3
    assert math.sqrt(sum(x * x for x in errors) / len(errors)) < 1.5 * spread


def test_no_python_in_the_plan(spark, documents, prose):
    plan = fingerprints.fingerprints(documents((1, prose(20, 1)), (2, prose(20, 2))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
