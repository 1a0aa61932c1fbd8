"""Draws documents that look like a target collection, by hashed n-grams.

Runs of one to three words are hashed into buckets by CRC-32 (see ``crc``). The
buckets' counts in all documents and in all target texts give every bucket a
gain, a log ratio in thousandths; a document weighs what its runs gain. Adding
Gumbel noise, decided by the document's id alone, and taking the highest scores
draws without replacement in proportion to the exponential of the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.crc import crc_of_runs
from lanternrank.llm.shared import part_files, slices
from lanternrank.llm.spans import ALNUM, words_of

WIDTH = 3
BUCKETS = 10_000
# Added to each bucket's count, in both collections.
SMOOTHING = 1
# Gains, weights and scores are in thousandths, rounded down.
UNIT = 1000
SEED = 42
PERCENT = 5
# Documents of fewer words are never drawn.
FEWEST_WORDS = 20


def _buckets(texts: pa.Array, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each run of words, text by text, and each text's words."""
    words = words_of(texts, ALNUM)
    counts = np.diff(words.first)
    first = np.repeat(words.first[:-1], counts)
    codes = crc_of_runs(words.data, words.start, words.end, first, width)
    there = np.arange(len(first))[:, None] - np.arange(width) >= first[:, None]
    return (codes % np.uint32(buckets))[there].astype(np.int64), counts


def _features(words: np.ndarray, width: int) -> np.ndarray:
    """How many runs of 1 to ``width`` words a text of so many words has."""
    return sum(np.maximum(words - k, 0) for k in range(width))


def bucket_counts(df: DataFrame, text_col: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: the runs of words of all texts, counted by bucket. A task
    passes on one count for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_buckets(part.column(0), width, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text_col: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: a row for each bucket at most comes to the driver."""

    def counts(df: DataFrame) -> np.ndarray:
        found = np.zeros(buckets)
        for row in bucket_counts(df, text_col, width, buckets).collect():
            found[row.bucket] = row.n
        return found

    s, t = counts(raw), counts(target)
    ratio = ((t + SMOOTHING) * (s.sum() + SMOOTHING * buckets)) / ((s + SMOOTHING) * (t.sum() + SMOOTHING * buckets))
    return np.floor(UNIT * np.log(ratio)).astype(np.int64)


def weigh(df: DataFrame, table: np.ndarray, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with ``n_words, n_features, weight``; a text without words weighs 0.
    Columns of these names are replaced, all others stay."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_weights(part.column(0), shared.value, width) for part in slices(pa.record_batch([batch], ["text"]), "text")]
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], ["n_words", "n_features", "weight"])

    weight = F.arrow_udf(run, "n_words long, n_features long, weight long").asNondeterministic()
    kept = [c for c in df.columns if c not in ("n_words", "n_features", "weight")]
    held = df.select(F.struct(*[F.col(c) for c in kept]).alias("row"), weight(F.col(text_col)).alias("found"))
    return held.select("row.*", "found.*")


def _weights(texts: pa.Array, table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, words = _buckets(texts, width, len(table))
    features = _features(words, width)
    sums = np.concatenate([[0], np.cumsum(table[found])])
    ends = np.cumsum(features)
    return words, features, sums[ends] - sums[ends - features]


def noise(id_col: str | Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by 32 bits of a digest of the id."""
    text = F.concat(F.lit(f"{seed}:"), (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(1 << 32))))).cast("long")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows``, a table, with ``position``: 1, 2, 3 ... in the given order.

    Partitions are ranges of that order; a row's position is its place in its
    partition after the sizes of those before, one number for each partition.
    Equal rows have a number of their own, so that many of them are cut as well.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [*order, F.col("_row")]
    each = each.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_row")
    # The partition in the upper 31 bits, the place in it in the lower 33.
    each = part_files(each.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = each.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    before, total = [], 0
    for row in sorted(sizes, key=lambda r: r.part):
        before.append((row.part, total))
        total += row.n
    table = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    each = each.withColumn("_part", part).join(F.broadcast(table), "_part")
    return each.withColumn("position", F.col("_before") + place + 1).drop("_at", "_part", "_before")


def draw(
    weighed: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, fewest: int = FEWEST_WORDS, seed: int = SEED
) -> DataFrame:
    """``id, n_features, weight, score, rank`` of every row; ``rank`` is 1, 2, 3 ...
    for the drawn ones, by score, ties to the smaller id, and NULL for others.

    ``percent`` of the rows with at least ``fewest`` words are drawn, rounded
    down. Rows with a NULL id have no score, do not count and are not drawn.
    Rows that share an id share its noise, and each counts.
    """
    scored = weighed.select(F.col(id_col).alias("_id"), "n_words", "n_features", "weight")
    scored = scored.withColumn("score", F.col("weight") + noise("_id", seed))
    able = (F.col("n_words") >= fewest) & F.col("score").isNotNull()
    scored = part_files(scored.withColumn("able", able), "scored")
    drawn = scored.where("able").count() * percent // 100
    ranked = numbered(scored, [F.desc("able"), F.desc("score"), F.asc("_id")])
    rank = F.when(F.col("able") & (F.col("position") <= drawn), F.col("position"))
    return ranked.select(F.col("_id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    percent: int = PERCENT, fewest: int = FEWEST_WORDS, seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns.

    NULL and empty texts have no words and are not drawn, unless ``fewest`` is 0.
    Rows of one id are drawn together. Empty tables give an empty result.
    """
    weighed = weigh(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), gains(docs, target, text_col), "_text")
    chosen = draw(weighed, "_id", percent, fewest, seed).where("rank is not null").select(F.col("_id").alias(id_col)).distinct()
    return docs.join(chosen, id_col, "left_semi")
