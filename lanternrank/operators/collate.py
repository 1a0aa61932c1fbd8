"""Records to ``(url, query, passage)`` or ``(index, label, lang, func)``.

Plain projections: a scan reads only the fields of the side that is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternrank.functions.text import collapse_ws, join_tokens, strip_comments


def _required(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"records lack {', '.join(missing)}")


def collate_csn(df: DataFrame, remain_format: bool = False) -> DataFrame:
    """Code search records; code with its format kept may be missing."""
    if remain_format:
        kept = F.col("code_wo_comment") if "code_wo_comment" in df.columns else F.lit(None)
        passage = F.coalesce(kept.cast("string"), F.lit(""))
    else:
        passage = join_tokens(F.col("code_tokens"))
    return df.select(
        F.col("url").cast("string").alias("url"),
        join_tokens(F.col("docstring_tokens")).alias("query"),
        passage.alias("passage"),
    )


def collate_cosqa_query(df: DataFrame) -> DataFrame:
    """Web queries, keyed by the position of their answer: ``url, query``."""
    _required(df, "retrieval_idx", "doc")
    return df.select(
        F.col("retrieval_idx").cast("string").alias("url"),
        collapse_ws(F.col("doc")).alias("query"),
    )


def collate_cosqa_code(df: DataFrame, remain_format: bool = False) -> DataFrame:
    """The code base that web queries are asked of: ``url, passage``."""
    _required(df, "url", "code_wo_comment" if remain_format else "code")
    passage = F.col("code_wo_comment") if remain_format else collapse_ws(F.col("code"))
    return df.select(F.col("url").cast("string").alias("url"), passage.alias("passage"))


def collate_cosqa(df: DataFrame, remain_format: bool = False) -> DataFrame:
    """Either side: records with ``retrieval_idx`` are queries."""
    if "retrieval_idx" in df.columns:
        return collate_cosqa_query(df)
    return collate_cosqa_code(df, remain_format)


def collate_advtest(df: DataFrame, remain_format: bool = False) -> DataFrame:
    """Records that serve as query and as passage."""
    _required(df, "function_wo_comment" if remain_format else "function_tokens")
    passage = (
        F.col("function_wo_comment") if remain_format else join_tokens(F.col("function_tokens"))
    )
    return df.select(
        F.col("url").cast("string").alias("url"),
        join_tokens(F.col("docstring_tokens")).alias("query"),
        passage.alias("passage"),
    )


def collate_code(
    df: DataFrame, lang: str | Column | None = None, on_error: str = "null"
) -> DataFrame:
    """Labelled code, comments removed and blanks collapsed.

    ``lang`` is one language, a column, or by default the column ``lang``.
    """
    _required(df, "index", "label", "func")
    language = F.lit(lang) if isinstance(lang, str) else F.col("lang") if lang is None else lang
    return df.select(
        F.col("index").cast("string").alias("index"),
        F.col("label").cast("int").alias("label"),
        language.alias("lang"),
        collapse_ws(strip_comments(F.col("func"), language, on_error)).alias("func"),
    )


_COLLATORS = {
    "csn": collate_csn,
    "cosqa": collate_cosqa,
    "advtest": collate_advtest,
}


def collate(df: DataFrame, layout: str, remain_format: bool = False) -> DataFrame:
    """Collate records of the named layout."""
    if layout not in _COLLATORS:
        raise ValueError(f"unknown layout {layout!r}, expected one of {sorted(_COLLATORS)}")
    return _COLLATORS[layout](df, remain_format)
