"""Prefix trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from scopelens.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, sequence string, parent string, part int"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, "s", "p", 2) for row in rows], SCHEMA)


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {conv: [x for *_, x in sorted(found)] for conv, found in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, mine in sorted(own.items()):
        head = zlib.crc32(str(conv).encode()) % 6
        whole = tuple(own.get(conv - conv % 100, [])[:head] + mine[head:])
        for depth in range(len(whole) + 1):
            members[whole[:depth]].append(conv)
        ends[whole].append(conv)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += (len(found) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            found[0],
            len(node),
            members[node[:-1]][0] if node else -1,
            len(found),
            children[node],
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        )
        for node, found in members.items()
    )


def found(df):
    return sorted(tuple(-1 if row[c] is None else row[c] for c in COLUMNS) for row in conversations.prefix_trie(df).collect())


def made(count, seed, hot=0.3):
    source = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(source.randrange(1, 9)):
            common = source.random() < hot
            rows.append((conv, turn, "user" if turn % 2 else "system", "the common turn é" if common else source.choice("abcdefgh") * source.randrange(1, 4)))
    return rows


@pytest.mark.parametrize(("shard", "chunk"), [(4096, 1 << 16), (3, 8), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, shard, chunk):
    rows = made(350, 1) + [(1000 + k, t, "user", "all the same") for k in range(120) for t in range(3)]
    monkeypatch.setattr(conversations._range_nodes, "__defaults__", (shard, chunk))
    assert found(table(spark, rows)) == brute(rows)


def test_many_ranges(spark):
    rows = made(200, 2, hot=0.8) + [(500 + k, t, "r", "x") for k in range(100) for t in range(2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert found(table(spark, rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_defined_cases(spark):
    rows = [
        (None, 0, "user", "no id"),
        (0, None, None, None),
        (0, 0, "user", "hello"),
        (0, 0, "user", "hello"),  # repeated row
        (0, 0, "assistant", "hello"),  # tie
        (5, 1, "user", None),
        (7, 1, None, "x" * 100_000),
        (205, 3, "a", "turnless where its base is absent"),
        (-5, 0, "a", "below zero"),
        (-105, 0, "a", "below zero"),
        (301, 0, "1", "1:x"),  # role and text are kept apart
        (302, 0, "11", ":x"),
    ] + [(400, t, "u", f"turn {t}") for t in range(900)]
    # c - c % 100 of a negative id goes towards zero
    expected = brute([(c, *rest) for c, *rest in rows if c is None or c >= 0])
    assert found(table(spark, [row for row in rows if row[0] is None or row[0] >= 0])) == expected
    assert len(found(table(spark, rows))) >= len(expected)
    assert found(table(spark, [])) == []
    assert found(table(spark, rows[:1])) == []


def test_shard_counts_by_binary_digits():
    a, b = b"a" * 16, b"b" * 16
    classes = [conversations.Class(a, [3], 5, 10, "x"), conversations.Class(a + b, [3, 4], 2, 7, "y"), conversations.Class(b, [1], 1, 9, "z")]
    rows = {(row[7], row[5]): row for row in conversations.Shard(classes, -1, -1).nodes()}
    assert rows[0, 7][8:12] == (8, 2, 2, (7 - 1) * 3 + (2 - 1) * 4)
    assert rows[1, 7][8:12] == (7, 1, 1, 6 * 3 + 4) and rows[1, 7][6] == 7
    assert rows[2, 7][8:12] == (2, 0, 1, 4)
    assert conversations.shared_turns(a + b, a) == 1 and conversations.shared_turns(b, a) == 0 and conversations.shared_turns(None, a) == -1
    assert conversations.shared_turns(a + b + a, a + b + b) == 2
