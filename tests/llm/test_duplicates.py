"""Operators on pairs and passages against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scopelens.llm import column_bwt, near_duplicates, near_vectors, repeats
from scopelens.llm.blocks import Hashes
from scopelens.llm.components import components
from tests.llm.conftest import rows_of

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def joined(ids, links):
    parent = {x: x for x in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in ids}


def test_components(spark):
    source = random.Random(1)
    links = [(source.randrange(60), source.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    expected = joined({x for pair in links for x in pair}, links)
    found = rows_of(components(spark.createDataFrame(links, "a long, b long")), "id", "component")
    touched = {x for a, b in links for x in (a, b) if a != b}
    assert found == {x: (expected[x],) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near_brute(rows, size, percent=80):
    sets = {i: shingles(text, size) for i, text in rows if i is not None}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    component = joined(sets, links)
    return {i: (len(sets[i]), component[i], component[i] == i) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(documents, prose, size):
    source, rows = random.Random(size), []
    for base in range(6):
        words = prose(60, base).split()
        for _ in range(8):
            edited = list(words)
            for _ in range(source.randrange(6)):
                edited[source.randrange(len(edited))] = f"w{source.randrange(999)}"
            rows.append((len(rows), " ".join(edited)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "One"), (104, "one"), (105, "one two"), (106, rows[0][1].upper())]
    rows += [(107, prose(9000, 99)), (108, prose(9000, 99) + " end"), (109, None)]
    found = near_duplicates.near_duplicates(documents(*rows, (None, "a b c")), shingle=size)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == near_brute(rows, size)


def test_near_duplicates_of_repeated_rows_and_none(documents):
    found = near_duplicates.near_duplicates(documents((1, "a b c"), (1, "a b c"), (2, "a b c")), shingle=2)
    assert rows_of(found, "doc_id", "component_id") == {1: (1,), 2: (1,)} and found.count() == 2
    assert near_duplicates.near_duplicates(documents()).count() == 0


def test_a_large_group_of_near_copies(documents, prose, monkeypatch):
    """Cells smaller than the group: links across them are found."""
    monkeypatch.setattr(near_duplicates, "SIDE", 8)
    source, words, rows = random.Random(5), prose(40, 3).split(), []
    for k in range(60):
        edited = list(words)
        for at in source.sample(range(40), 3):
            edited[at] = f"v{k}"
        rows.append((k, " ".join(edited)))
    found = near_duplicates.near_duplicates(documents(*rows), shingle=2)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == near_brute(rows, 2)


def test_odd_sketches_estimate_high_similarity():
    source = np.random.default_rng(1)
    both = source.integers(0, 2**63, 1000).astype(np.uint64)
    for share in (0.95, 0.9, 0.8):
        own = int(1000 * (1 - share) / (1 + share))
        sets = [np.unique(np.append(both[own:], source.integers(0, 2**63, own).astype(np.uint64))) for _ in range(2)]
        _, sketches = near_duplicates._signatures(sets)
        differ = int(np.bitwise_count((sketches[0] ^ sketches[1]).view(np.uint64)).sum())
        samples = -near_duplicates.SKETCH_BITS / 4 * math.log(1 - 2 * differ / near_duplicates.SKETCH_BITS)
        similar = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert abs(1 - samples / near_duplicates.SAMPLES - similar) < 0.12


def cut_brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            part = data[k : k + length]
            if part in seen:
                gone[k : k + length] = [True] * length
            seen.add(part)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(prose):
    shared = [prose(30, 50 + k) for k in range(4)]
    rows = [(k, " ".join([prose(20, k), shared[k % 4][k:], prose(10, 70 + k), shared[(k + 1) % 4]])) for k in range(24)]
    rows += [(30, None), (31, ""), (32, "x" * 350), (33, "ab" * 200), (34, rows[3][1]), (35, rows[3][1]), (36, "é" * 120), (37, "é" * 120)]
    rows += [(38, prose(3000, 9) + rows[2][1]), (39, shared[0][:100]), (40, shared[0][:99]), (41, shared[1][7:107])]
    return rows


@pytest.mark.parametrize("collection", [60_000, 3])
def test_repeats(documents, prose, monkeypatch, collection):
    monkeypatch.setattr(repeats, "COLLECTION", collection)
    rows = passages(prose)
    found = repeats.digest(repeats.without_repeats(documents(*rows, (None, "z" * 300))))
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut_brute(rows, 100)


def test_passages_that_differ_next_to_a_shared_anchor_are_no_repeats(documents, prose):
    """Half a million pairs that have all but six bytes in common, so that few bits of a hash would not tell them apart."""
    source = np.random.default_rng(4)
    anchors = source.integers(97, 123, (200_000, repeats.ANCHOR)).astype(np.uint8)
    ends = np.arange(1, len(anchors) + 1) * repeats.ANCHOR
    least = int(Hashes(anchors.ravel()).of(ends - repeats.ANCHOR, ends).argmin())  # the anchor of every string that holds it
    shared = anchors[least].tobytes().decode()
    rows = [(k, f"{prose(12, 1)[:40]}{shared}{k:06d}{prose(20, 2)[:60]}") for k in range(1000)]
    rows += [(1000, rows[7][1]), (1001, f"{prose(9, 3)[:30]}{rows[8][1][10:]}")]
    found = repeats.digest(repeats.without_repeats(documents(*rows)))
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut_brute(rows, 100)


def test_repeats_keep_other_columns_and_repeated_rows(documents, prose):
    text = prose(40, 1)
    found = repeats.without_repeats(documents((1, text), (1, text), (2, text)))
    assert {"lang", "id", "score", "ids"} <= set(found.columns)
    assert sorted((r.doc_id, len(r.spans)) for r in found.collect()) == [(1, 0), (1, 0), (2, 1)]
    assert repeats.without_repeats(documents()).count() == 0


def test_column_wise_transform():
    source = random.Random(2)
    for _ in range(20):
        strings = [bytes(source.choice(b"ab\0") for _ in range(source.randint(0, 12))) for _ in range(source.randint(1, 10))]
        found = [
            (strings[w][s:], p)
            for who, start, shared in column_bwt.sorted_suffixes(strings)
            for w, s, p in zip(who.tolist(), start.tolist(), shared.tolist())
        ]
        assert [x for x, _ in found] == sorted(x[k:] for x in strings for k in range(len(x)))
        for (a, _), (b, shared) in zip(found, found[1:]):
            if a[0] == b[0]:
                assert shared == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def vectors_brute(rows, cosine=0.98):
    usable = {
        i: (label, np.array(v, float))
        for i, v, label in rows
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    links = [
        (a, b)
        for a, (la, va) in usable.items()
        for b, (lb, vb) in usable.items()
        if a < b and la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= cosine
    ]
    counts, component = Counter(x for pair in links for x in pair), joined([i for i, *_ in rows], links)
    return {i: (counts[i], component[i], component[i] == i) for i, *_ in rows}


@pytest.mark.parametrize("side", [512, 4])
def test_near_vectors(spark, monkeypatch, side):
    monkeypatch.setattr(near_vectors, "SIDE", side)
    source, rows = np.random.default_rng(3), []
    for group in range(5):
        centre = source.standard_normal(16)
        for _ in range(9):
            rows.append((len(rows), (centre + 0.12 * source.standard_normal(16)).tolist(), group % 2))
    rows += [(100 + k, rows[0][1], 0) for k in range(4)]
    rows += [(110, None, 0), (111, [], 0), (112, [0.0] * 16, 0), (113, [1.0, None] * 8, 0), (114, [float("nan")] * 16, 0)]
    rows += [(115, [float("inf")] * 16, 0), (116, rows[0][1], None), (117, rows[0][1], 1), (118, rows[0][1][:8], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "'c' AS codes", "2 AS cell")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    found = near_vectors.near_vectors(df)
    assert rows_of(found, "vec_id", "n_links", "component_id", "kept") == vectors_brute(exact)


def test_near_vectors_of_repeated_rows_and_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    found = near_vectors.near_vectors(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0], 0)], kind))
    assert rows_of(found, "vec_id", "n_links", "component_id", "kept") == {1: (0, 1, True)}
    assert near_vectors.near_vectors(spark.createDataFrame([], kind)).count() == 0
