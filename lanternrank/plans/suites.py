"""Evaluation suites: records to one report row per data set or language."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternrank.operators.collate import collate, collate_code
from lanternrank.operators.embed import Encoder, embed, encoder
from lanternrank.operators.metrics import retrieval_report
from lanternrank.operators.precision import average_precision, map_score
from lanternrank.operators.remote import RemoteEncoder, embed_by_ledger
from lanternrank.operators.search import DEFAULT_DEPTH, first_hit_rank
from lanternrank.operators.sweep import Limits
from lanternrank.sources.records import (
    CODE_LANGS,
    DATASETS,
    DISPLAY_ORDER,
    Spec,
    catalogue,
    content_ids,
    materialize,
    read_code,
    read_records,
    with_ids,
)

PLACES = 4  # decimal places of a displayed figure


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def texts(
    spark: SparkSession, specs: Sequence[Spec], remain_format: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Queries and passages of all collections: ``dataset, id, key, text``.

    Passages are numbered by what they hold, so that equal scores rank alike
    however the files are laid out; equal passages of a key share a number.
    """
    def read(path: str, schema: str, spec: Spec) -> DataFrame:
        return collate(read_records(spark, path, schema), spec.layout, remain_format)

    def side_of(rows: DataFrame, spec: Spec, role: str) -> DataFrame:
        return rows.select(
            F.lit(spec.dataset).alias("dataset"),
            F.col("url").alias("key"),
            F.col(role).alias("text"),
        )

    asked, offered = [], []
    for spec in specs:
        if spec.same_file:
            # Read and collated once; both sides are columns of that table.
            both = materialize(read(spec.query_path, spec.query_schema, spec), spec.dataset)
            queries = passages = both
        else:
            queries = read(spec.query_path, spec.query_schema, spec)
            passages = read(spec.passage_path, spec.passage_schema, spec)
        asked.append(side_of(queries, spec, "query"))
        offered.append(side_of(passages, spec, "passage"))
    return with_ids(_union(asked)), content_ids(_union(offered), "dataset", "key", "text")


Model = str | Encoder | RemoteEncoder


def embed_side(
    rows: DataFrame, model: Model, role: str, text_col: str = "text", ledger: str | None = None
) -> DataFrame:
    """Embed a side once and keep it as a table for the passes that follow.

    The model is an encoder or the name of a registered one. A remote service
    writes its answers to a table as they come (``ledger``); rows that it failed
    on have a NULL vector, so that as passages they are no candidates and as
    queries they are misses, like NULL texts under any model.
    """
    model = encoder(model) if isinstance(model, str) else model
    if isinstance(model, RemoteEncoder):
        return embed_by_ledger(rows, text_col, model, role, ledger=ledger).drop(text_col, "error")
    return materialize(embed(rows, text_col, model, role).drop(text_col), f"{role}-vectors")


def suite_ranks(
    queries: DataFrame,
    passages: DataFrame,
    depth: int = DEFAULT_DEPTH,
    limits: Limits = Limits(),
) -> DataFrame:
    """First-hit ranks of all data sets in one job; they never mix."""
    return first_hit_rank(queries, passages, depth, by="dataset", limits=limits)


def long_report(report: DataFrame, suite: str, by: str) -> DataFrame:
    """A wide report as rows ``suite, dataset, metric, value``."""
    metrics = [c for c in report.columns if c not in (by, "queries")]
    return report.unpivot([by], metrics, "metric", "value").select(
        F.lit(suite).alias("suite"), F.col(by).alias("dataset"), "metric", "value"
    )


def display(
    values: DataFrame, by: str, value: str, order: Sequence[str], places: int = PLACES
) -> DataFrame:
    """Rounded figures of the names in ``order``, in that order.

    ``position`` is the place in the full order; absent names leave a gap.
    """
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col(by)).cast("int")
    return (
        values.select(place.alias("position"), by, F.round(value, places).alias(value))
        .where(F.col("position") > 0)
        .orderBy("position")
    )


def display_line(shown: DataFrame, value: str) -> DataFrame:
    """The figures as one tab-joined line; a suite has few rows."""
    pairs = F.array_sort(F.collect_list(F.struct("position", F.col(value).alias("figure"))))
    figures = F.transform(pairs, lambda p: p["figure"].cast("string"))
    return shown.agg(F.array_join(figures, "\t").alias("line"))


def run_suite(
    spark: SparkSession,
    root: str,
    model: Model,
    datasets: tuple[str, ...] = DATASETS,
    use_valid: bool = False,
    remain_format: bool = False,
    limits: Limits = Limits(),
    ledger: str | None = None,
) -> DataFrame:
    """Text-to-code search: one wide report row per data set or language.

    With a remote model ``ledger`` may name a shared folder, so that a suite
    that was stopped goes on from the answers it has.
    """
    asked, offered = texts(spark, catalogue(root, datasets, use_valid), remain_format)
    queries = embed_side(asked, model, "query", ledger=ledger and f"{ledger}/query")
    passages = embed_side(offered, model, "passage", ledger=ledger and f"{ledger}/passage")
    return retrieval_report(suite_ranks(queries, passages, limits=limits), by="dataset")


def show_suite(report: DataFrame) -> DataFrame:
    """MRR@1000 per data set, rounded, in display order."""
    return display(report, "dataset", "mrr_at_1000", DISPLAY_ORDER)


def run_code_suite(
    spark: SparkSession,
    directory: str,
    model: Model,
    langs: tuple[str, ...] = CODE_LANGS,
    on_error: str = "raise",
    limits: Limits = Limits(),
    ledger: str | None = None,
) -> DataFrame:
    """Code-to-code search within each language: ``lang, map``.

    Records are numbered by what they hold, see ``texts``; those of one language
    that are equal in index and code are one.
    """
    code = content_ids(collate_code(read_code(spark, directory, langs), on_error=on_error), "lang", "index", "func")
    vectors = embed_side(code, model, "passage", "func", ledger)
    return map_score(vectors, by="lang", limits=limits)


def show_code_suite(scores: DataFrame, langs: Sequence[str] = CODE_LANGS) -> DataFrame:
    """MAP per language, rounded, in display order."""
    return display(scores, "lang", "map", langs)


def cross_map(
    vectors: DataFrame, src_lang: str, tgt_lang: str, limits: Limits = Limits()
) -> DataFrame:
    """MAP of queries in one language against candidates in another."""
    src, tgt = (vectors.where(F.col("lang") == x) for x in (src_lang, tgt_lang))
    return map_score(src, None if src_lang == tgt_lang else tgt, limits=limits)


def cross_maps(vectors: DataFrame, limits: Limits = Limits(), by: str = "domain") -> DataFrame:
    """MAP of each domain's queries against each other domain: ``pair, map``.

    One job for all pairs: candidates pass once, in the group of their own
    domain; a query goes to the groups of all others and names its own in the
    end. ``vectors`` has one row per id.
    """
    named = vectors.withColumnRenamed(by, "_own")
    every = named.agg(F.collect_set("_own")).scalar()
    others = named.withColumn("_every", every)
    asked = others.withColumn("_target", F.explode(F.array_remove("_every", F.col("_own")))).drop("_own", "_every")
    scored = average_precision(asked, named.withColumnRenamed("_own", "_target"), by="_target", limits=limits)
    own = named.select(F.col("id").alias("query_id"), "_own")
    return (
        scored.join(own, "query_id")
        .groupBy(F.concat_ws(">", "_own", "_target").alias("pair"))
        .agg(F.avg("ap").alias("map"))
    )
