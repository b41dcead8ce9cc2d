"""The prefix trie of conversations, built from ternary search trees.

Turns are encoded as numbers of a sorted dictionary of all (role, text), and
equal conversations become one sequence with its count. Sequences are put in
order and cut into shards by range. A task inserts its shard's sequences into a
ternary search tree, the middle one first and then the middles of both halves,
so that the tree is balanced, and walks it with a stack of its own: the nodes
of a trie are in a shard as a whole unless they lie on the path of its first
or its last sequence. Whole nodes are done there. The boundary paths of all
shards, two rows each, carry what was summed below their nodes and go through
the same step again, in fewer shards, until one shard is left.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import col
from emberlog.session import stage

# Turns (at the upper levels, nodes of boundary paths) that one shard's tree is made for.
SHARD_TURNS = 100_000
# Paths per shard at least, so that every level has a quarter of the paths of the one before.
LEAST_PATHS = 8
# Ids in one piece of a node's list of members.
PIECE_IDS = 4096
# Nodes given out at once.
BATCH_NODES = 10_000

VALUES = ("least", "members", "children", "leaves", "saved")
# A path from the root, with values for each of its nodes: one more than turns.
PATH = "turns array<long>, chars array<long>, " + ", ".join(f"{v} array<long>" for v in VALUES) + ", ends array<string>"
NODE = ("path string, parent string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
        " n_leaves long, saved_tokens long, ends_sha256 string")
OUTPUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(conversations: DataFrame, shared: int = 100, most: int = 6) -> DataFrame:
    """Rebuilt conversations: ``conv_id, turns, chars`` (numbers of the dictionary, code points of the texts).

    Conversation c takes its first h turns from conversation c - c % ``shared``,
    all if that has fewer and none if there is no such, and the rest from its
    own turns after the first h; h is the CRC-32 of c in decimals modulo
    ``most``. Turns are in order of ``turn``, null first, then of role and text;
    null roles and texts are empty. Rows without ``conv_id`` belong to none.
    """
    said = conversations.filter(col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "code", "chars")
    # A conversation is one row of numbers, 16 bytes a turn.
    rows = _encoded(said).groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("said"))
    rows = stage(rows.select("conv_id", F.arrays_zip(
        F.col("said.code").alias("code"), F.col("said.chars").alias("chars")).alias("said")), "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = rows.select(F.col("conv_id").alias("base"), F.slice("said", 1, most).alias("head"))
    own = rows.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % shared}).join(heads, "base", "left")
    size = F.greatest(F.size("said") - F.col("h"), F.lit(0))
    turns = F.concat(F.slice(F.coalesce("head", F.slice("said", 1, 0)), F.lit(1), F.col("h")), F.slice("said", F.col("h") + 1, size))
    return stage(own.select("conv_id", turns.alias("said")).select(
        "conv_id", F.col("said.code").alias("turns"), F.col("said.chars").alias("chars")), "rebuilt")


def _encoded(said: DataFrame) -> DataFrame:
    """``conv_id, turn, code, chars``: codes rise with (role, text), by a dictionary of the distinct ones."""
    said = said.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "text", "role")})
    tasks = int(said.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = said.groupBy("a", "b", "role", "text").agg(F.lit(1).alias("one")).drop("one")
    words = words.repartitionByRange(tasks, "role", "text").sortWithinPartitions("role", "text")
    words = stage(words.select("a", "b", F.monotonically_increasing_id().alias("code"),
                               F.char_length("text").cast("long").alias("chars")), "dictionary")
    return said.select("conv_id", "turn", "a", "b").join(words, ["a", "b"])


def trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conv_id, turns, chars``: the columns OUTPUT.

    A node is a sequence of first turns, from the root without any; its members
    are the conversations that start with it. ``conv_id`` is the smallest
    member, ``parent_conv_id`` the parent's (null for the root), ``n_convs`` and
    ``n_children`` count members and children, ``n_leaves`` the childless nodes
    of the subtree, ``saved_tokens`` sums over the subtree the code points of a
    node's last text for every member but one, and ``ends_sha256`` is the
    SHA-256 of the ascending ids, joined by commas, of members that end there.
    No conversation, no node.
    """
    paths = stage(_distinct(sequences), "trie_paths")
    levels = []
    while True:
        rows, turns = paths.agg(F.count("*"), F.coalesce(F.sum(F.size("turns") + 1), F.lit(0))).first()
        shards = min(-(-turns // SHARD_TURNS), rows // LEAST_PATHS)
        last = shards <= 1
        dealt = paths.coalesce(1) if last else paths.repartitionByRange(shards, "turns")
        made = f"node struct<{NODE.replace(' ', ':').replace(',:', ',')}>, path struct<{PATH.replace(', ', ',').replace(' ', ':')}>"
        done = stage(dealt.sortWithinPartitions("turns").mapInArrow(_shard(last), made), "trie_level")
        levels.append(done.filter("node IS NOT NULL").select("node.*"))
        if last:
            break
        paths = done.filter("path IS NOT NULL").select("path.*")
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    if len(levels) == 1:
        return nodes.select(*OUTPUT)
    # Nodes whose parent was not yet whole when they were done; such parents came out of the upper levels.
    upper = levels[1]
    for more in levels[2:]:
        upper = upper.unionByName(more)
    known = stage(upper.select(F.col("path").alias("parent"), F.col("conv_id").alias("found")), "trie_parents")
    joined = nodes.filter("parent IS NOT NULL").join(known, "parent").withColumn("parent_conv_id", F.col("found"))
    return nodes.filter("parent IS NULL").select(*OUTPUT).unionByName(joined.select(*OUTPUT))


def _distinct(sequences: DataFrame) -> DataFrame:
    """One path per distinct sequence, in the columns PATH."""
    rows = sequences.withColumns({"a": F.xxhash64("turns"), "b": F.xxhash64(F.lit(1), "turns")})
    counted = rows.groupBy("a", "b", "turns", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    joined = counted.join(stage(_ends(rows.select("a", "b", "conv_id")), "trie_ends"), ["a", "b"])
    nodes = F.size("turns") + 1
    zeros = F.array_repeat(F.lit(0).cast("long"), nodes)
    return joined.select(
        "turns", "chars", F.array_repeat("least", nodes).alias("least"), F.array_repeat("n", nodes).alias("members"),
        zeros.alias("children"), zeros.alias("leaves"), zeros.alias("saved"),
        F.concat(F.array_repeat(F.lit(None).cast("string"), F.size("turns")), F.array("sha")).alias("ends"))


def _ends(members: DataFrame) -> DataFrame:
    """``a, b, sha``: the hash of the ascending ids of each sequence.

    Ids are joined to pieces where a range exchange has put them, so that the
    many ids of one sequence are read by many tasks; the task that hashes a
    sequence reads its pieces one after the other and keeps none.
    """
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = members.repartitionByRange(tasks, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(
        _pieces, "a long, b long, conv_id long, ids string")
    pieces = pieces.repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "conv_id")
    return pieces.mapInArrow(_hashed, "a long, b long, sha string")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, most = ["a", "b", "conv_id", "ids"], PIECE_IDS
    key, first, ids = None, None, []
    for batch in batches:
        out = []
        for a, b, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if (a, b) != key or len(ids) >= most:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids = (a, b), conv, []
            ids.append(str(conv))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, first, ",".join(ids))], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, key, state = ["a", "b", "sha"], None, None
    for batch in batches:
        out = []
        for a, b, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if (a, b) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names)


class Tree:
    """A ternary search tree over sequences of numbers; node 0 is the trie's root."""

    def __init__(self):
        self.code, self.low, self.same, self.high = [0], [0], [0], [0]
        self.chars, self.ends = [0], [None]
        self.values = {v: [None if v == "least" else 0] for v in VALUES}

    def _new(self, code: int, chars: int) -> int:
        for column, value in ((self.code, code), (self.low, 0), (self.same, 0), (self.high, 0), (self.chars, chars), (self.ends, None)):
            column.append(value)
        for name, column in self.values.items():
            column.append(None if name == "least" else 0)
        return len(self.code) - 1

    def _child(self, at: int, code: int, chars: int) -> int:
        """The child of trie node ``at`` for ``code``, made if there is none."""
        found, link = self.same[at], self.same
        while found:
            at = found
            if code == self.code[at]:
                return at
            link = self.low if code < self.code[at] else self.high
            found = link[at]
        link[at] = self._new(code, chars)
        return link[at]

    def add(self, path: dict) -> list[int]:
        """Insert a path and add its values to its nodes, whose numbers are returned."""
        at, nodes = 0, [0]
        for code, chars in zip(path["turns"], path["chars"]):
            at = self._child(at, code, chars)
            nodes.append(at)
        for name, column in self.values.items():
            for node, value in zip(nodes, path[name]):
                if name != "least":
                    column[node] += value
                elif value is not None:
                    column[node] = value if column[node] is None else min(column[node], value)
        for node, sha in zip(nodes, path["ends"]):
            self.ends[node] = self.ends[node] or sha
        return nodes

    def walk(self) -> list[tuple[int, int, int]]:
        """(node, parent, depth) of all trie nodes, parents before children."""
        found, waiting = [(0, -1, 0)], [(self.same[0], 0, 1)]
        while waiting:
            node, parent, depth = waiting.pop()
            if node:
                found.append((node, parent, depth))
                waiting += [(self.low[node], parent, depth), (self.high[node], parent, depth), (self.same[node], node, depth + 1)]
        return found


def middles(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    waiting = deque([(0, n)])
    while waiting:
        a, b = waiting.popleft()
        if a < b:
            middle = (a + b) // 2
            yield middle
            waiting += [(a, middle), (middle + 1, b)]


def _shard(last: bool):
    """Nodes that are done, and the boundary paths of what is not; at the last level all are done."""
    nothing = hashlib.sha256(b"").hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [row for batch in batches for row in batch.to_pylist()]
        if not paths:
            return
        tree, placed = Tree(), {}
        for i in middles(len(paths)):
            nodes = tree.add(paths[i])
            if i in (0, len(paths) - 1):
                placed[i] = nodes
        edge = set() if last else {n for nodes in placed.values() for n in nodes}
        order, v = tree.walk(), tree.values
        key = {-1: ""}
        for node, parent, _ in order:
            key[node] = hashlib.blake2b(f"{key[parent]}/{tree.code[node]}".encode(), digest_size=16).hexdigest()
        rows = []
        for node, parent, depth in reversed(order):
            if node in edge:
                continue
            v["leaves"][node] += v["children"][node] == 0
            v["saved"][node] += (v["members"][node] - 1) * tree.chars[node]
            if parent >= 0:
                for name, more in (("children", 1), ("leaves", v["leaves"][node]), ("saved", v["saved"][node])):
                    v[name][parent] += more
            waits = parent in edge
            rows.append((key[node], key[parent] if waits else None, v["least"][node], depth,
                         None if waits or parent < 0 else v["least"][parent], v["members"][node], v["children"][node],
                         v["leaves"][node], v["saved"][node], tree.ends[node] or nothing))
            if len(rows) >= BATCH_NODES:
                yield given(rows, [])
                rows = []
        told, left = set(), []
        for i in sorted(placed) if not last else ():
            path = dict(paths[i])
            # What the first path has told of a node is not told again by the last.
            fresh = [n not in told for n in placed[i]]
            for name in VALUES:
                path[name] = [v[name][n] if new or name == "least" else 0 for n, new in zip(placed[i], fresh)]
            path["ends"] = [tree.ends[n] for n in placed[i]]
            left.append(path)
            told |= set(placed[i])
        yield given(rows, left)

    def given(rows, left):
        names = [x.split()[0] for x in NODE.split(", ")]
        types = [pa.string() if x.endswith(" string") else pa.int64() for x in NODE.split(", ")]
        node = pa.struct(list(zip(names, types)))
        path = pa.struct([(x.split()[0], pa.list_(pa.string() if "string" in x else pa.int64())) for x in PATH.split(", ")])
        columns = [pa.array([dict(zip(names, r)) for r in rows] + [None] * len(left), node),
                   pa.array([None] * len(rows) + left, path)]
        return pa.RecordBatch.from_arrays(columns, ["node", "path"])

    return work
