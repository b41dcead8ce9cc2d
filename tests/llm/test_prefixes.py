"""The prefix trie of conversations, against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberlog.llm import prefixes

TABLE = "conv_id long, turn long, role string, text string"
NAMES = prefixes.OUTPUT


def rebuilt(rows):
    said = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(turns)] for c, turns in said.items()}
    out = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = said.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) if below else 1
        saved[path] = sum(saved[b] for b in below) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def trie(df):
    return sorted(tuple(r[c] for c in NAMES) for r in prefixes.trie(prefixes.rebuilt(df)).collect())


def talks(seed, n, kinds=3, longest=9):
    pick = random.Random(seed)
    return [(c, t, pick.choice(["user", "assistant"]), "é" * pick.randrange(kinds)) for c in pick.sample(range(10 * n), n)
            for t in range(pick.randrange(1, longest))]


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(prefixes, "SHARD_TURNS", 60)
    monkeypatch.setattr(prefixes, "LEAST_PATHS", 4)
    monkeypatch.setattr(prefixes, "PIECE_IDS", 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_shard(spark, seed):
    rows = talks(seed, 120)
    assert trie(spark.createDataFrame(rows, TABLE).repartition(4)) == brute(rebuilt(rows))


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_many_shards_and_levels(spark, small_shards, seed):
    rows = talks(seed, 400, kinds=seed - 1, longest=4 * seed)
    assert trie(spark.createDataFrame(rows, TABLE).repartition(4)) == brute(rebuilt(rows))


def test_hot_groups_and_a_long_conversation(spark, small_shards):
    """A third of all conversations are equal, a third share their beginning, one is very long."""
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300) for t in range(3)]
    rows += [(c, t, "user", "hello" if t < 6 else f"own {c}") for c in range(300, 400) for t in range(8)]
    rows += [(777, t, "assistant", "x" * (t % 4)) for t in range(3000)]
    assert trie(spark.createDataFrame(rows, TABLE).repartition(5)) == brute(rebuilt(rows))


def test_dirty_rows(spark):
    rows = [(1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, 1, "user", "a"),
            (100, 5, "", "😀"), (102, None, None, "x" * 100_000), (103, 1, "user", ""), (-7, 1, "user", "a"), (205, 1, "a", "b"), (205, 1, "ab", "")]
    df = spark.createDataFrame(rows, TABLE).repartition(3)
    for name in ("code", "chars", "a", "b", "said", "h", "base", "node", "path", "turns"):
        df = df.withColumn(name, F.lit("mine"))
    expected = rebuilt([r for r in rows if r[0] != -7])
    own = zlib.crc32(b"-7") % 6  # its remainder by 100 is negative, so that conversation 0 is meant
    expected[-7] = [("user", "a")][own:]
    assert trie(df) == brute(expected)
    assert trie(df.limit(0)) == []


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(101, 160)]  # no conversation 100, so that most have nothing left
    got = trie(spark.createDataFrame(rows, TABLE))
    assert got == brute(rebuilt(rows)) and got[0][3] == 59 and got[0][7] != hashlib.sha256(b"").hexdigest()
    lone = [(c, 0, "user", "only") for c in (101, 104) if zlib.crc32(str(c).encode()) % 6]
    assert len(trie(spark.createDataFrame(lone, TABLE))) == 1


def test_middles_come_first():
    assert list(prefixes.middles(7)) == [3, 1, 5, 0, 2, 4, 6] and sorted(prefixes.middles(100)) == list(range(100))
    tree = prefixes.Tree()
    for code in prefixes.middles(1000):
        tree.add({"turns": [code], "chars": [1], "ends": [None, "x"], **{v: [0, 0] for v in prefixes.VALUES}})
    depth, waiting = 0, [(tree.same[0], 1)]
    while waiting:
        node, d = waiting.pop()
        if node:
            depth = max(depth, d)
            waiting += [(tree.low[node], d + 1), (tree.high[node], d + 1)]
    assert depth == 10
