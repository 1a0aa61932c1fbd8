"""Near copies by SimHash: all pairs of fingerprints within a few bits, exactly.

A text's fingerprint has 64 bits, each the majority of that bit among the hashes
of its runs of words. Equal fingerprints are one node, whatever their number.

Nodes are put in a vantage-point tree: an inner node has a fingerprint, the
vantage point, and a radius; what lies within the radius goes left, all else
right. If two fingerprints differ in at most r bits, their distances from any
point differ by at most r. So a search goes down a side only if the node lies
there or within r of the boundary.

The upper levels are laid out on a bounded sample of the nodes and cut all nodes
into shards. A node lives in one shard and visits those to the right of it that
its boundaries overlap; of two near nodes one visits the other's home. Each
shard's task builds the lower levels over the nodes that live there. Pairs do
not leave a task, only links that connect what they connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.shared import connected, over_slices, part_files, scratch
from lanternrank.llm.spans import NOT_BLANK, run_bounds, words_of
from lanternrank.operators.sweep import GROUP, Kernel, run_cells

WIDTH = 4
SEED = 42
RADIUS = 4
# Nodes on which the upper levels are laid out.
SAMPLE = 1 << 16
# Shards of any number of nodes, and nodes that live in a shard at most: the
# more shards, the more of them a node visits.
SHARDS, SHARD = 16, 1 << 18
# Fingerprints in a leaf, compared with all that come to it.
LEAF = 96
# Comparisons done at once.
PAIRS = 1 << 18
# Hashes whose bits are counted at once.
CODES = 1 << 15
# Fingerprints that hold more than one in so many rows are told to all tasks.
HOT = 512


def _majority(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` codes, the bits set in more than half of them."""
    ones = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for lo in range(0, len(codes), CODES):
        bits = np.unpackbits(codes[lo : lo + CODES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[lo : lo + CODES]
        new = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        ones[mine[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    most = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints_of(texts: pa.Array, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Fingerprint of each text; of all its words as one run if they are fewer."""
    words = words_of(texts, NOT_BLANK)
    n = np.diff(words.first)
    starts, counts = run_bounds(words, width)
    lasts = starts + width - 1
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        at = np.searchsorted(starts, words.first[few])
        starts, lasts = np.insert(starts, at, words.first[few]), np.insert(lasts, at, words.first[few + 1] - 1)
        counts[few] = 1
    data, hashed = words.data.tobytes(), xxhash.xxh64_intdigest
    begin, end = words.start[starts].tolist(), words.end[lasts].tolist()
    codes = np.fromiter((hashed(data[a:b], seed) for a, b in zip(begin, end)), np.uint64, len(begin))
    return _majority(codes, counts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``id, node`` of every row; ``node`` is the fingerprint as a signed long, 0
    for NULL, empty and blank texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = fingerprints_of(batch.column(1), width, seed)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "node"])

    return over_slices(rows, "text", work, f"id {rows.schema['id'].dataType.simpleString()}, node long")


@dataclass
class Tree:
    """A side of a boundary: either a leaf with a number, or a vantage point, a
    radius and two sides. Leaves are numbered from left to right."""

    leaf: int = -1
    point: np.uint64 = np.uint64(0)
    radius: int = 0
    left: Tree | None = None
    right: Tree | None = None
    members: np.ndarray | None = None


def distance(codes: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(codes ^ point).astype(np.int64)


def grow(codes: np.ndarray, size: int, leaves: list[Tree], members: np.ndarray | None = None) -> Tree:
    """A tree over distinct codes with leaves of about ``size``, each appended to
    ``leaves``; a side is no further divided if a point cannot divide it."""
    members = np.arange(len(codes)) if members is None else members
    stack = [root := Tree()]
    root.members = members
    while stack:
        node = stack.pop()
        mine = node.members
        if len(mine) > size:
            point = codes[mine[0]]
            d = distance(codes[mine], point)
            cut = np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]
            cut = cut if (d > cut).any() else cut - 1
            inner = d <= cut
            if inner.any() and not inner.all():
                node.point, node.radius, node.members = point, int(cut), None
                node.left, node.right = Tree(members=mine[inner]), Tree(members=mine[~inner])
                stack += [node.right, node.left]
                continue
        node.leaf = len(leaves)
        leaves.append(node)
    return root


def visits(tree: Tree, codes: np.ndarray, radius: int, home: bool) -> Iterator[tuple[Tree, np.ndarray, np.ndarray]]:
    """``leaf, positions, at home`` for all leaves that the codes go to.

    A code at home goes to its own side, and from the left to the right if the
    boundary is within the radius; a visitor goes wherever one near it can be.
    """
    stack = [(tree, np.arange(len(codes)), np.full(len(codes), home))]
    while stack:
        node, at, own = stack.pop()
        if not len(at):
            continue
        if node.leaf >= 0:
            yield node, at, own
            continue
        d = distance(codes[at], node.point)
        inside = d <= node.radius
        left = np.where(own, inside, d - radius <= node.radius)
        right = np.where(own, ~inside | (d + radius > node.radius), d + radius > node.radius)
        stack.append((node.right, at[right], own[right] & ~inside[right]))
        stack.append((node.left, at[left], own[left]))


class Forest:
    """Groups of positions, as links come in by arrays."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def extend(self, n: int) -> None:
        self.up = np.concatenate([self.up, np.arange(len(self.up), len(self.up) + n)])

    def root(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while True:
            above = self.up[x]
            if (above == x).all():
                return x
            x = self.up[above]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root(a), self.root(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


class Shard(Kernel):
    """Turn 0: the nodes that live here. Turn 1: visitors."""

    SCHEMA = "a long, b long"

    def __init__(self, radius: int) -> None:
        super().__init__()
        self.radius = radius

    def take(self, turn: int, part: pa.RecordBatch) -> None:
        if turn == 0:
            self._held.append(part)
            return
        self._build()
        if self._started:
            self.feed(part)

    def _build(self) -> None:
        if self._held:
            self.start(pa.Table.from_batches(self._held))
            self._started, self._held = True, []

    def start(self, resident: pa.Table) -> None:
        self.codes = resident["id"].to_numpy().view(np.uint64)
        self.tree = grow(self.codes, LEAF, [])
        self.forest = Forest(len(self.codes))
        self.visitors: list[np.ndarray] = []
        self._match(self.codes, 0, True)

    def feed(self, part: pa.RecordBatch) -> None:
        codes = part.column("id").to_numpy(zero_copy_only=False).view(np.uint64)
        base = len(self.forest.up)
        self.forest.extend(len(codes))
        self.visitors.append(self._match(codes, base, False))

    def _match(self, codes: np.ndarray, base: int, home: bool) -> np.ndarray:
        """Joins what is near; of visitors, positions and codes that met any."""
        met = np.zeros(len(codes), bool)
        for leaf, at, _ in visits(self.tree, codes, self.radius, home):
            step = max(1, PAIRS // len(leaf.members))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                near = np.bitwise_count(codes[some][:, None] ^ self.codes[leaf.members]) <= self.radius
                row, col = np.divmod(np.flatnonzero(near), near.shape[1])
                self.forest.join(base + some[row], leaf.members[col])
                met[some[row]] = True
        at = np.flatnonzero(met)
        return np.stack([(base + at).astype(np.int64), codes[at].view(np.int64)])

    def result(self) -> Iterator[pa.RecordBatch]:
        self._build()
        if not self._started:
            return
        # A group's least position is one that lives here.
        home = np.arange(len(self.codes))
        places = np.concatenate([home, *[v[0] for v in self.visitors]])
        values = np.concatenate([self.codes.view(np.int64), *[v[1] for v in self.visitors]])
        root = self.forest.root(places)
        linked = root != places
        roots = self.codes.view(np.int64)[root[linked]]
        for lo in range(0, len(roots), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(values[linked][lo : lo + (1 << 16)]), pa.array(roots[lo : lo + (1 << 16)])], ["a", "b"])


def _shards(nodes: DataFrame, radius: int, sample: int, shards: int, most: int) -> DataFrame:
    """``grp, id, cell, turn``: every node in its home and in the shards it visits."""
    spark = nodes.sparkSession
    n = nodes.count()
    parts = max(shards, -(-n // most))
    chosen = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(sample).toPandas()["node"].to_numpy(np.int64)
    tree = grow(chosen.view(np.uint64), max(1, -(-len(chosen) // parts)), [])
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for leaf, at, own in visits(shared.value, ids.view(np.uint64), radius, True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([""] * len(at), pa.string()), pa.array(ids[at]), pa.array(np.full(len(at), leaf.leaf, np.int32)), pa.array(np.where(own, 0, 1).astype(np.int32))],
                    [GROUP, "id", "cell", "turn"],
                )

    return nodes.select("node").mapInArrow(run, f"{GROUP} string, id long, cell int, turn int")


def near_links(nodes: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shards: int = SHARDS, most: int = SHARD) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints of ``nodes(node)``, a table of
    distinct ones, that pairs within ``radius`` bits connect."""
    rows = _shards(nodes, radius, sample, shards, most)
    return run_cells(rows, None, partial(Shard, radius), Shard.SCHEMA)


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
    width: int = WIDTH, seed: int = SEED, sample: int = SAMPLE, shards: int = SHARDS, most: int = SHARD,
) -> DataFrame:
    """``id, fingerprint, component_id`` of every row.

    Rows link if their fingerprints differ in at most ``radius`` bits; the
    component is the smallest id reachable by links. NULL, empty and blank texts
    have the fingerprint 0 and link like any other. Rows with a NULL id have a
    fingerprint and connect others; a component without any id is NULL. Repeated
    rows stay; other columns are left out.
    """
    spark = docs.sparkSession
    with scratch(spark):
        told = part_files(fingerprints(docs, id_col, text_col, width, seed), "fingerprints", keep=True)
        nodes = part_files(told.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n")), "nodes")
        links = part_files(near_links(nodes, radius, sample, shards, most), "links")
        whole = part_files(connected(links), "components")
        named = nodes.join(whole, "node", "left").withColumn("group", F.coalesce("component", "node"))
        least = named.groupBy("group").agg(F.min("id").alias("component_id"))
        final = part_files(named.join(least, "group").select("node", "n", "component_id"), "final", keep=True)
        total = told.count()
    # At most HOT fingerprints hold more than a HOT-th of all rows: those rows
    # stay where they are, and no task gets all rows of one fingerprint.
    hot = F.broadcast(final.where(F.col("n") * HOT > total).drop("n"))
    rest = told.join(hot, "node", "left_anti").join(final.drop("n"), "node")
    out = told.join(hot, "node").unionByName(rest)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
