"""Joins documents by the Jaccard similarity of their word n-grams.

A document's n-grams are put in one global order, rare ones first. Two documents
that reach the threshold share at least l n-grams among the first
``n - ceil(t * n) + l`` of each. Every document picks its own l: a longer prefix
costs more postings, but asks for more shared ones before anything is compared.

Only connectivity is wanted, so a posting list is not expanded into all pairs.
First each document is compared with the first one of each of its lists; then
documents outside the group that leads a list with the others of that list.
Whatever shares enough and is not yet connected is compared: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.shared import connected, mixed, over_slices, part_files, scratch, slices, window_hashes
from lanternrank.llm.spans import NOT_BLANK, word_codes, words_of

WIDTH = 5
PERCENT = 80
# Most shared n-grams that a prefix is lengthened for.
MOST_SHARED = 8
# Cost of comparing two documents, in postings.
COMPARE = 20.0
# Postings expected of an n-gram that is not known to be frequent.
RARE = 0.1
# N-grams known as frequent: those of the largest counts, from a least count.
FREQUENT, LEAST = 1 << 18, 8
# Nodes of a family that is compared in blocks, if it has more, and of a block.
FAMILY, BLOCK = 64, 256
# N-grams that a task counts before it passes on what it saw twice or more.
COUNTED = 1 << 22


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashed runs of ``width`` words, sorted; all words if fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))


def _each(batch: pa.RecordBatch, column: str, width: int) -> Iterator[np.ndarray]:
    words = words_of(batch.column(column), NOT_BLANK)
    codes, first = word_codes(words), words.first.tolist()
    for start, end in zip(first, first[1:]):
        yield shingles(codes[start:end], width)


def _name(s: np.ndarray, seed: int) -> tuple[int, int]:
    """128 bits of a set."""
    x = mixed(s + np.uint64(seed * 2 + 1))
    y = mixed(s ^ np.uint64(0xA0761D6478BD642F))
    a = mixed(np.array([x.sum() + np.uint64(len(s))], np.uint64))
    return int(a.view(np.int64)[0]), int(y.sum(dtype=np.uint64).astype(np.int64))


def digests(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """Two kinds of rows from one pass: ``id, n, node, check`` of every document,
    and ``token, times`` of n-grams that a task saw in several different documents."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, seen = [], 0, set()
        id_type = None
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(_each(part, "text", width))
                names = [_name(s, seed) if len(s) else (0, 0) for s in sets]
                id_type = part.column(0).type
                yield _digest(part.column(0), [len(s) for s in sets], names)
                for s, name in zip(sets, names, strict=True):
                    if len(s) and name not in seen:
                        seen.add(name)
                        waiting.append(s)
                        size += len(s)
                if size > COUNTED:
                    yield _times(waiting, id_type)
                    waiting, size, seen = [], 0, set()
        if waiting:
            yield _times(waiting, id_type)

    return kept.mapInArrow(run, f"id {kind}, n long, node long, check long, token long, times long")


NAMES = ["id", "n", "node", "check", "token", "times"]


def _digest(ids: pa.Array, sizes: list[int], names: list[tuple[int, int]]) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    a, b = (pa.array([x[k] for x in names], pa.int64()) for k in (0, 1))
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), a, b, none, none], NAMES)


def _times(sets: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    more = counts > 1
    none = pa.nulls(int(more.sum()), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(none), id_type), none, none, none,
         pa.array(tokens[more].view(np.int64)), pa.array(counts[more])], NAMES,
    )


def least_shared(n: int, percent: int) -> int:
    """N-grams that a set of n shares at least with any set it is similar to."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, tokens: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set and the number of n-grams that it asks to share.

    ``tokens`` (sorted) and ``counts`` are the frequent n-grams. The order is by
    count, those not known first, then by hash.
    """
    times = np.zeros(len(s), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        times = np.where(tokens[at] == s, counts[at], 0)
    # In order of hashes already; only those that are known move.
    known = np.flatnonzero(times)
    order = np.concatenate([np.flatnonzero(times == 0), known[np.argsort(times[known], kind="stable")]])
    n, need = len(s), least_shared(len(s), percent)
    most = min(MOST_SHARED, need)
    postings = np.cumsum(np.where(times > 0, times, RARE)[order])
    shared = np.arange(1, most + 1)
    lists = postings[n - need + shared - 1]
    ell = int(shared[np.argmin(lists + COMPARE * lists / shared)])
    return s[order[: n - need + ell]], ell


def prefixes(texts: DataFrame, frequent, width: int, percent: int, seed: int) -> DataFrame:
    """``node, n, ell, prefix`` of every text with words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        tokens, counts = frequent.value
        sets = [s for s in _each(batch, "text", width) if len(s)]
        if not sets:
            return None
        cut = [prefix(s, tokens, counts, percent) for s in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array([_name(s, seed)[0] for s in sets], pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()),
             pa.array([e for _, e in cut], pa.int32()), _lists([p for p, _ in cut])],
            ["node", "n", "ell", "prefix"],
        )

    return over_slices(texts, "text", work, "node long, n long, ell int, prefix array<long>")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sets(docs: DataFrame, nodes: DataFrame, reps: DataFrame, width: int, seed: int) -> DataFrame:
    """``node, set`` of the given nodes, from the text of one document of each."""
    ids = nodes.join(reps, "node").select("id", "node")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(_each(batch, "text", width))
        names = pa.array([_name(s, seed)[0] if len(s) else 0 for s in sets], pa.int64())
        return pa.RecordBatch.from_arrays([names, _lists(sets)], ["node", "set"])

    found = over_slices(docs.join(ids.select("id"), "id", "left_semi").select("text"), "text", work, "node long, set array<long>")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sets reach the threshold, compared in full."""
    near = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    near = near.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            a, b = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                x, y = a[k].values.to_numpy(), b[k].values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return near.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar(percent: int):
    """Sizes n and m may belong to similar sets."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """``id, n_shingles, component_id`` of every row.

    A row's set are its distinct hashed runs of ``width`` words, all its words
    if there are fewer. Rows link if ``100 * |both| >= percent * |either|``, and
    the component is the smallest id reachable by links. Rows with equal sets
    are one node, whatever their number. NULL and empty texts, and texts without
    words, have an empty set and link with nothing; their component is their own
    id. Rows with a NULL id are kept, but link with nothing and have no
    component. Repeated rows stay; other columns are left out.

    Words and n-grams are compared by 64-bit hashes, sets by 128 bits.
    """
    spark = docs.sparkSession
    with scratch(spark):
        seed = 0
        while True:
            told = part_files(digests(docs, id_col, text_col, width, seed), "digests", keep=True)
            rows = told.where("n > 0").select("id", "node", "check", "n")
            rows = rows.where("id is not null")
            reps = part_files(rows.groupBy("node", "check", "n").agg(F.min("id").alias("id")), "nodes")
            if reps.groupBy("node").count().where("count > 1").isEmpty():
                break
            seed += 1
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
        seen = told.where("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
        frequent = _frequent(seen)
        # What is frequent in these prefixes goes behind in those that are joined.
        first_cut = _postings(texts, frequent, width, percent, seed).groupBy("token").agg(F.count("*").alias("times"))
        frequent = _frequent(seen.union(first_cut).groupBy("token").agg(F.max("times").alias("times")))
        with scratch(spark):
            postings = part_files(_postings(texts, frequent, width, percent, seed), "postings")

            lead = postings.groupBy("token").agg(F.min(F.struct("node", "n", "ell")).alias("lead"), F.count("*").alias("size"))
            lists = postings.join(lead.where("size > 1").select("token", "lead"), "token")
            lists = part_files(lists.select("token", "node", "n", "ell", "lead"), "lists", keep=True)
        star = lists.where("node != lead.node").select(
            F.col("node").alias("a"), F.col("lead.node").alias("b"), "n", F.col("lead.n").alias("m"),
            F.least("ell", "lead.ell").alias("ell"),
        )
        star = part_files(_enough(star, percent), "star")
        links = part_files(_links(star, _sets(texts, _ends(star), reps, width, seed), percent), "links")
        first = part_files(connected(links), "groups")

        # Many documents that share much, linked or not: compared in blocks.
        family = part_files(_families(star, first), "families")
        blocks = family.where("blocks > 0")
        inside = part_files(_in_blocks(blocks, _sets(texts, blocks.select("node"), reps, width, seed), percent), "blocks")

        # Lists that one group does not fill: who is outside the leader's group meets all.
        named = lists.join(first, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
        named = named.join(blocks.select("node", "family"), "node", "left")
        named = part_files(named.select("token", "node", "n", "ell", "group", "family", F.col("lead.node").alias("lead")), "named")
        leads = named.where("node = lead").select("token", F.col("group").alias("main"))
        outside = named.join(leads, "token").where("group != main").drop("main", "lead")
        other = named.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("ell").alias("ell_b"), F.col("group").alias("group_b"), F.col("family").alias("family_b"))
        apart = F.coalesce(F.col("family") != F.col("family_b"), F.lit(True))
        rest = outside.join(other, "token").where((F.col("group") != F.col("group_b")) & apart & similar(percent))
        rest = rest.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"), "n", "m", F.least("ell", "ell_b").alias("ell"), "token")
        rest = rest.distinct().select("a", "b", "n", "m", "ell")
        pairs = part_files(_enough(rest, percent).join(star, ["a", "b"], "left_anti"), "rest")
        more = _links(pairs, _sets(texts, _ends(pairs), reps, width, seed), percent)
        whole = part_files(connected(links.union(more).union(inside)), "components")

        ids = reps.join(whole, "node", "left").withColumn("group", F.coalesce("component", "node"))
        least = ids.groupBy("group").agg(F.min("id").alias("component_id"))
        final = part_files(ids.join(least, "group").select("node", "component_id"), "final", keep=True)
    out = told.where("token is null").select("id", "n", "node").join(final, "node", "left")
    own = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _families(star: DataFrame, groups_of: DataFrame) -> DataFrame:
    """``node, group, family, blocks`` of the nodes that share enough with a leader.

    A family is connected by such pairs, linked or not. ``blocks`` tells in how
    many blocks a large one is compared, 0 for small ones and for those that
    links connect already.
    """
    nodes = connected(star).withColumnRenamed("component", "family").join(groups_of, "node", "left")
    nodes = nodes.select("node", "family", F.coalesce("component", "node").alias("group"))
    size = nodes.groupBy("family").agg(F.count("*").alias("size"), (F.min("group") != F.max("group")).alias("open"))
    many = F.when(F.col("open") & (F.col("size") > FAMILY), F.ceil(F.col("size") / BLOCK)).otherwise(0)
    return nodes.join(size, "family").select("node", "family", "group", many.cast("int").alias("blocks"))


def _in_blocks(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` within large families, every two blocks in a task.

    Every node goes to its own block's tasks, as many as the family has blocks; a
    task compares all pairs of its nodes in different groups and returns no more
    links than connect them.
    """
    rows = nodes.join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        node, group = part["node"].to_numpy(), part["group"].to_numpy()
        lists = part["set"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(node)), sizes)
        token = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        root = {g: g for g in group.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        by = np.argsort(token, kind="stable")
        first = np.searchsorted(token[by], np.arange(token.max() + 2 if len(token) else 1))
        found = []
        for k in range(len(node)):
            own = token[ends[k] - sizes[k] : ends[k]]
            start, count = first[own], first[own + 1] - first[own]
            at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
            both = np.bincount(row[by[at]], minlength=len(node))
            near = np.flatnonzero(100 * both[:k] >= percent * (sizes[k] + sizes[:k] - both[:k]))
            for m in near:
                a, b = find(int(group[k])), find(int(group[m]))
                if a != b:
                    root[a] = b
                    found.append((int(node[k]), int(node[m])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("family", "i", "j", "node", "group", "set").groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def _frequent(seen: DataFrame):
    """The n-grams of the largest counts, sorted by hash, for every worker: at most FREQUENT."""
    often = seen.where(F.col("times") >= LEAST).orderBy(F.desc("times"), "token").limit(FREQUENT).toPandas()
    tokens, times = often["token"].to_numpy(np.int64).view(np.uint64), often["times"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return seen.sparkSession.sparkContext.broadcast((tokens[order], times[order]))


def _postings(texts: DataFrame, frequent, width: int, percent: int, seed: int) -> DataFrame:
    """``token, node, n, ell``: the prefix of every node."""
    cut = prefixes(texts.select("text"), frequent, width, percent, seed)
    cut = cut.groupBy("node").agg(F.first(F.struct("n", "ell", "prefix")).alias("p")).select("node", "p.*")
    return cut.select(F.explode("prefix").alias("token"), "node", "n", "ell")


def _enough(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that share as many n-grams as the less demanding side asks for."""
    near = pairs.where(similar(percent)).groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("ell").alias("ell"))
    return near.where("shared >= ell").select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest id.

    Documents in no group stay. Rows with the same id share its fate, and those
    that also have the same text are one.
    """
    found = groups(docs, id_col, text_col, width, percent)
    away = found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(away, id_col, "left_anti").select(docs.columns).dropDuplicates([id_col, text_col])
