"""One query for each corpus operator, over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lanternrank.llm import bpe, centroids, decontaminate, html_text, importance, jaccard_join, labelled_pages, language_id, licenses, line_dedup, quality, toxicity, url_filter, vantage
from lanternrank.llm.oracle import SQL
from lanternrank.llm.shared import held_out
from lanternrank.sources.session import read_table

__all__ = ["QUERIES", "SQL"]


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and licence notice that stands in it."""
    return licenses.scan(read_table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that occurs in it, with the edits."""
    docs = read_table(spark, folder, "documents")
    return decontaminate.matches(docs, read_table(spark, folder, "benchmark"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict for every page: by rule, else by the list of tracking hosts."""
    pages = read_table(spark, folder, "pages")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host"))
    cascade = url_filter.build(hosts, url_filter.tracking_hosts(pages), "host")
    return url_filter.judge_urls(pages, cascade)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, voted by its nearest labelled examples."""
    docs = read_table(spark, folder, "documents")
    index = toxicity.train(docs, read_table(spark, folder, "labels"))
    return toxicity.score(docs, index).select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page, by a field trained on the labelled pages."""
    pages = read_table(spark, folder, "pages")
    return html_text.main_text(pages, html_text.train(labelled_pages.labelled()))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose 4-word shingles have a Jaccard similarity of 0.85."""
    return jaccard_join.groups(read_table(spark, folder, "documents"), width=4, percent=85)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one."""
    docs = read_table(spark, folder, "documents")
    return line_dedup.dedup(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read_table(spark, folder, "documents")
    model = language_id.model_for(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.identify(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "words"
    )


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the likelihood ratio's verdict for every document."""
    docs = read_table(spark, folder, "documents")
    ratios = quality.keep_table(docs, read_table(spark, folder, "labels"))
    return quality.judge(docs, ratios)


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes they decode to."""
    docs = read_table(spark, folder, "documents")
    words = bpe.vocabulary(
        spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    coded = bpe.decode(bpe.encode(docs, words), words)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.joined("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    """The weight and score of every document, and the rank of those drawn."""
    docs = read_table(spark, folder, "documents")
    gains = importance.gains(docs, read_table(spark, folder, "benchmark"))
    return importance.draw(importance.weigh(docs, gains))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every vector after three rounds around 16 centroids."""
    return centroids.clusters(read_table(spark, folder, "embeddings"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of every document and its group of near ones."""
    return vantage.groups(read_table(spark, folder, "documents"))


QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_licenses, op2_decontamination, op3_url_filter, op4_toxicity, op5_html_text, op6_jaccard_join, op7_line_dedup, op8_language_id, op9_quality, op10_bpe, op11_importance, op12_centroids, op13_simhash)}
