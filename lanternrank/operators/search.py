"""Exact nearest neighbours and the rank of the first right answer.

Queries and passages are tables ``(id bigint, key string, embedding)``; ``id``
is unique, ``key`` need not be: every passage with the query's key is a right
answer. ``by`` names a column that keeps collections apart, so that many are
searched in one job.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lanternrank.operators.kernels import TICKS_PER_UNIT, BestMatch, CountAhead, TopK, pair_ticks
from lanternrank.operators.sweep import (
    GROUP,
    TASKS_PER_CORE,
    Fit,
    Grid,
    Limits,
    lay_out,
    measure,
    shuffle_tasks,
    side,
    sweep,
)

# Neighbours searched by default, and depth of an evaluation.
DEFAULT_K = 5
DEFAULT_DEPTH = 1000

PILOT = 64  # one in so many passages is looked at for a first bound
KEY_PAIRS = 1 << 20  # pairs of a key that one task of a join may get


def _named(by: str | None) -> list:
    return [F.col(GROUP).alias(by)] if by else []


def _best_first() -> WindowSpec:
    return Window.partitionBy(GROUP, "query_id").orderBy(F.desc("ticks"), "passage_id")


def _with_floor(resident: DataFrame, stream: DataFrame, k: int, fit: Fit, grid: Grid | None) -> DataFrame:
    """Queries with the score of their k-th best among a part of the passages.

    The k-th best of all is at least as good, so nothing below can be among
    the k best. This only keeps tasks from returning what cannot win.
    """
    part = stream.where(F.pmod(F.xxhash64("id"), F.lit(PILOT)) == 0)
    floors = (
        sweep(resident, part, partial(TopK, k), TopK.SCHEMA, fit, grid)
        .withColumn("position", F.row_number().over(_best_first()))
        .where(F.col("position") == k)
        .select(GROUP, F.col("query_id").alias("id"), F.col("ticks").alias("floor"))
    )
    return resident.join(floors, [GROUP, "id"], "left")


def knn_join(
    queries: DataFrame,
    passages: DataFrame,
    k: int = DEFAULT_K,
    by: str | None = None,
    limits: Limits = Limits(),
    pilot: bool | None = None,
) -> DataFrame:
    """The k passages nearest to each query: ``query_id, passage_id, score, rank``.

    Score is cosine similarity to nine places; equal scores are ranked by id.
    Every task keeps at most k candidates per query, and only those are
    shuffled for the final ranking. With very many tasks (``pilot``, decided by
    their number if not given) a first look at few passages bounds what tasks
    return; the result is the same.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    resident, stream = side(queries, by), side(passages, by)
    fit = measure(resident, TopK.BYTES_PER_K * k, limits)
    grid = None if fit.broadcast or fit.empty else lay_out(resident, stream, fit, limits, TopK.ROW_BYTES * k)
    if pilot is None:
        pilot = TASKS_PER_CORE * shuffle_tasks(resident) > 8 * PILOT
    if pilot:
        resident = _with_floor(resident, stream, k, fit, grid)
    # Shuffled by name: a task's lists hold at most k per query already, and a
    # limit before the shuffle, which Spark would add, only sorts them once more.
    nearest = sweep(resident, stream, partial(TopK, k), TopK.SCHEMA, fit, grid).repartition(
        GROUP, "query_id"
    )
    return (
        nearest.withColumn("position", F.row_number().over(_best_first()))
        .where(F.col("position") <= k)
        .select(
            *_named(by),
            "query_id",
            "passage_id",
            (F.col("ticks") / F.lit(float(TICKS_PER_UNIT))).alias("score"),
            F.col("position").cast("bigint").alias("rank"),
        )
    )


def first_hits(
    neighbours: DataFrame, queries: DataFrame, passages: DataFrame, by: str | None = None
) -> DataFrame:
    """Rank of the first neighbour with the query's key; NULL if there is none.

    For neighbours that were searched already. Both joins are on unique ids.
    """
    within = [by] if by else []
    wanted = queries.select(*within, F.col("id").alias("query_id"), "key")
    offered = passages.select(*within, F.col("id").alias("passage_id"), "key")
    hits = (
        neighbours.join(wanted, [*within, "query_id"])
        .join(offered, [*within, "passage_id", "key"])
        .groupBy(*within, "query_id")
        .agg(F.min("rank").alias("rank"))
    )
    return (
        wanted.join(hits, [*within, "query_id"], "left")
        .select(*within, "query_id", "key", "rank")
    )


def best_answers(resident: DataFrame, stream: DataFrame, fit: Fit, limits: Limits = Limits()) -> DataFrame:
    """``grp, id, gold_ticks, gold_id``: each query's best passage with its key.

    Only pairs of one key are scored. Broadcast queries find theirs where the
    passages lie. Else both sides are joined by key, but for keys of more than
    KEY_PAIRS pairs: each of those is cut into cells like a group of its own, so
    that a key which many passages share is no more work for one task.
    """
    asked = resident.select(GROUP, "key").distinct()
    if fit.broadcast or fit.empty:
        known = F.broadcast(asked) if fit.broadcast_keys else asked
        answers = stream.join(known, [GROUP, "key"], "left_semi").select(*stream.columns)
        found = sweep(resident, answers, BestMatch, BestMatch.SCHEMA, fit)
    else:
        sizes = resident.groupBy(GROUP, "key").agg(F.count("*").alias("q")).join(
            stream.groupBy(GROUP, "key").agg(F.count("*").alias("p")), [GROUP, "key"]
        )
        hot = sizes.where(F.col("q").cast("double") * F.col("p") > KEY_PAIRS).select(GROUP, "key")
        rows = hot.limit(limits.groups + 1).collect()
        if len(rows) <= limits.groups:
            hot = F.broadcast(resident.sparkSession.createDataFrame(rows, hot.schema))
        found = _joined(resident, stream, hot if rows else None)
        if rows:
            found = found.unionByName(_hot_keys(resident, stream, hot, fit, limits))
    return (
        found.groupBy(GROUP, F.col("query_id").alias("id"))
        .agg(F.min(F.struct(-F.col("gold_ticks"), "gold_id")).alias("gold"))
        .select(GROUP, "id", (-F.col("gold.col1")).alias("gold_ticks"), "gold.gold_id")
    )


def _joined(resident: DataFrame, stream: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Pairs of one key by an equi-join."""
    if hot is not None:
        resident, stream = (x.join(hot, [GROUP, "key"], "left_anti") for x in (resident, stream))
    asked = resident.select(GROUP, "key", F.col("id").alias("query_id"), F.col("embedding").alias("asked"))
    pairs = asked.join(stream.select(GROUP, "key", F.col("id").alias("gold_id"), "embedding"), [GROUP, "key"])
    score = F.arrow_udf(pair_ticks, "bigint")
    return pairs.select(GROUP, "query_id", "gold_id", score("asked", "embedding").alias("gold_ticks"))


def _hot_keys(resident: DataFrame, stream: DataFrame, hot: DataFrame, fit: Fit, limits: Limits) -> DataFrame:
    """Best matches within the given keys, each a group that is cut into cells."""
    name = F.to_json(F.struct(F.col(GROUP).alias("g"), F.col("key").alias("k")))

    def of(rows: DataFrame) -> DataFrame:
        return rows.join(hot, [GROUP, "key"], "left_semi").withColumn(GROUP, name).select(rows.columns)

    asked, offered = of(resident), of(stream)
    grid = lay_out(asked, offered, fit, limits)
    found = sweep(asked, offered, BestMatch, BestMatch.SCHEMA, fit, grid)
    return found.withColumn(GROUP, F.get_json_object(GROUP, "$.g"))


def first_hit_rank(
    queries: DataFrame,
    passages: DataFrame,
    depth: int = DEFAULT_DEPTH,
    by: str | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Rank of each query's best right answer: ``query_id, key, rank``.

    The same ranks as searching ``depth`` neighbours and looking for the first
    hit, but by counting: the rank of a passage is one more than the number of
    passages ahead of it. Counts add up over any split of the passages, so a
    task sends one number per query instead of ``depth`` rows. A rank beyond
    ``depth`` and a query without an answer are NULL.
    """
    resident = side(queries, by, F.col("key"))
    stream = side(passages, by, F.col("key"))
    fit = measure(resident, 64, limits)
    grid = None if fit.broadcast or fit.empty else lay_out(resident, stream, fit, limits)
    best = best_answers(resident, stream, fit, limits)
    aimed = resident.drop("key").join(best, [GROUP, "id"])
    ranks = (
        sweep(aimed, stream.drop("key"), CountAhead, CountAhead.SCHEMA, fit, grid)
        .groupBy(GROUP, "query_id")
        .agg((F.sum("ahead") + 1).alias("rank"))
        .where(F.col("rank") <= depth)
    )
    group = F.col(by).cast("string") if by else F.lit("")
    everyone = queries.select(group.alias(GROUP), F.col("id").alias("query_id"), "key")
    return everyone.join(ranks, [GROUP, "query_id"], "left").select(
        *_named(by), "query_id", "key", "rank"
    )
