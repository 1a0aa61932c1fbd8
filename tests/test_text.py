import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternrank.functions import text as t


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


def many(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    found = rows.select("i", column(F.col("s")).alias("o")).orderBy("i").collect()
    return [r.o for r in found]


SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_whitespace_is_what_split_splits_on(spark):
    values = [f"{SPACES}a{SPACES}b{SPACES}", "a​b", "", SPACES, "one  two\n\tthree"]
    values += [f"x{c}y" for c in SPACES]
    assert many(spark, t.collapse_ws, values) == [" ".join(v.split()) for v in values]


def test_join_tokens_skips_null(spark):
    df = spark.createDataFrame([(["a", None, "b"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(t.join_tokens("v")).collect()] == ["a b", "", None]


def test_blank_lines(spark):
    assert one(spark, t.drop_blank_lines, "a\n \t\n\n  b\n　\n") == "a\n  b"


def scanner(s):
    """Comment removal one character at a time."""
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c in "'\"":
            j = i + 1
            while j < len(s) and s[j] != c:
                j += 2 if s[j] == "\\" else 1
            if j < len(s):
                out.append(s[i : j + 1])
                i = j + 1
                continue
        if s.startswith("//", i):
            end = s.find("\n", i)
            i = len(s) if end < 0 else end
            out.append(" ")
            continue
        if s.startswith("/*", i) and s.find("*/", i + 2) >= 0:
            i = s.find("*/", i + 2) + 2
            out.append(" ")
            continue
        out.append(c)
        i += 1
    return "\n".join(x for x in "".join(out).split("\n") if x.strip())


@pytest.mark.parametrize(
    "source, expected",
    [
        ("a/**/b", "a b"),
        ('"http://x" // y', '"http://x"  '),
        ("'//' x", "'//' x"),
        ("it's // c", "it's  "),
        ("/* open", "/* open"),
        ("a // b\r\nc", "a  \nc"),
        (r"'\'//' // x", r"'\'//'  "),
        ("a\n/* x\ny */\nb", "a\nb"),
        ("# kept", "# kept"),
    ],
)
def test_c_comments(spark, source, expected):
    assert one(spark, t.strip_c_comments, source) == expected


def test_c_comments_equal_a_scanner(spark):
    rng = random.Random(7)
    values = ["".join(rng.choices("/*'\"\\\n ab\r", k=rng.randint(0, 40))) for _ in range(4000)]
    values += ["'" + "\\n" * 50_000 + "' // x", "/*" * 500 + "*/x", "a" * 300_000 + "//"]
    assert many(spark, t.strip_c_comments, values) == [scanner(v) for v in values]


def test_dispatch_by_language(spark):
    rows = [
        ("python", "x = 1  # c"),
        ("ruby", "x = 1 # c\n\n"),
        ("java", "x; // c"),
        ("php", "$x; # c"),
        ("python", "def f(:\n  ("),
    ]
    df = spark.createDataFrame(rows, "lang string, s string")
    found = [r[0] for r in df.select(t.strip_comments(F.col("s"), F.col("lang"))).collect()]
    assert found == ["x = 1  ", "x = 1 # c\n\n", "x;  ", "$x; # c", None]


def test_unparsable_python(spark):
    bad = "x = '''"
    assert one(spark, t.strip_py_comments, bad) is None
    assert one(spark, lambda c: t.strip_py_comments(c, "keep"), bad) == bad
    with pytest.raises(Exception, match="never closed"):
        one(spark, lambda c: t.strip_py_comments(c, "raise"), bad)
    with pytest.raises(ValueError):
        t.strip_py_comments(F.col("s"), "ignore")


def test_instruct(spark):
    assert one(spark, t.instruct, "sort a list") == (
        "Instruct: Given a code search query, retrieve relevant code snippet that answer the query"
        "\nQuery: sort a list"
    )


def letters():
    return (lambda s: list(s)), "".join


def test_truncate(spark):
    assert one(spark, lambda c: t.truncate_tokens(c, 2), "a b c") == "a b"
    assert one(spark, lambda c: t.truncate_tokens(c, 9), "a  b ") == "a  b "
    assert one(spark, lambda c: t.truncate_tokens(c, 2, letters), "abc") == "ab"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nab　\x1c", max_size=12), min_size=1, max_size=20))
def test_collapse_any_text(spark, values):
    assert many(spark, t.collapse_ws, values) == [" ".join(v.split()) for v in values]
