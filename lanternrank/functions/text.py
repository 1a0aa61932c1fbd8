"""String expressions used to prepare queries and code for embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternrank.functions.python_source import strip_python

# They decide the result and must stay as they are.
# Every code point that Unicode treats as whitespace in str.split().
WHITESPACE = (
    r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
SEARCH_TASK = (
    "Given a code search query, retrieve relevant code snippet that answer the query"
)
MAX_TOKENS = 8192
PYTHON_LANGS = ("python",)
UNCHANGED_LANGS = ("ruby",)

# One lexeme of a C-like source: a quoted literal, a comment, or other text.
_C_LEXEME = (
    r"(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    r'|"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    r"|//[^\n]*+"
    r"|/\*.*?\*/"
    r"|[^/'\"]++"
    r"|."
)


def join_tokens(tokens: Column) -> Column:
    """Tokens joined by single spaces; NULL tokens are skipped."""
    return F.array_join(tokens, " ")


def collapse_ws(text: Column) -> Column:
    """Runs of Unicode whitespace become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def drop_blank_lines(text: Column) -> Column:
    """Lines that hold nothing but whitespace are removed."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda line: line.rlike(f"[^{WHITESPACE}]")), "\n")


def strip_c_comments(text: Column) -> Column:
    """``//`` and ``/* */`` comments become one space; literals stay intact."""
    lexemes = F.regexp_extract_all(text, F.lit(_C_LEXEME), F.lit(0))
    kept = F.transform(
        lexemes,
        lambda s: F.when(s.startswith("//") | s.startswith("/*"), " ").otherwise(s),
    )
    return drop_blank_lines(F.array_join(kept, ""))


def strip_py_comments(source: Column, on_error: str = "null") -> Column:
    """Python source without comments and docstrings.

    Bracket depth decides what a line end means, so this is not a regular
    language and runs as an Arrow-batched UDF. ``on_error`` says what an
    unparsable source becomes: ``null``, ``keep`` (the source) or ``raise``.
    """
    if on_error not in ("null", "keep", "raise"):
        raise ValueError(f"on_error must be null, keep or raise, not {on_error!r}")

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return strip_python(text)
        except SyntaxError:
            if on_error == "raise":
                raise
            return text if on_error == "keep" else None

    @F.pandas_udf(T.StringType())
    def strip(batch: pd.Series) -> pd.Series:
        return batch.map(one, na_action="ignore")

    return drop_blank_lines(strip(source))


def strip_comments(source: Column, lang: Column, on_error: str = "null") -> Column:
    """Comment removal by language, for tables that mix languages.

    Python sources reach the UDF, all others are NULL there, so only Python
    text is lexed in Python.
    """
    is_python = lang.isin(*PYTHON_LANGS)
    python_only = F.when(is_python, source)
    return (
        F.when(is_python, strip_py_comments(python_only, on_error))
        .when(lang.isin(*UNCHANGED_LANGS), source)
        .otherwise(strip_c_comments(source))
    )


def instruct(query: Column, task: str = SEARCH_TASK) -> Column:
    """The query with its task description in front."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def truncate_tokens(
    text: Column,
    max_tokens: int = MAX_TOKENS,
    codec: Callable[[], tuple[Callable, Callable]] | None = None,
) -> Column:
    """The first ``max_tokens`` tokens of a text.

    Tokens are separated by single spaces and this stays in the JVM. For a
    sub-word tokenizer pass ``codec``, a factory of ``(encode, decode)``
    functions; it is called once per task.
    """
    if codec is None:
        return F.array_join(F.slice(F.split(text, " ", -1), 1, max_tokens), " ")

    @F.pandas_udf(T.StringType())
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = codec()
        for batch in batches:
            yield batch.map(lambda t: decode(encode(t)[:max_tokens]), na_action="ignore")

    return cut(text)
