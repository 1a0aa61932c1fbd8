import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternrank.functions import tokens as tk
from lanternrank.functions import vectors as v


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(50, 7)), rng.normal(size=(50, 7))
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "i int, a array<float>, b array<float>")


def test_cosine_by_two_ways(pairs):
    unit = [v.l2_normalize(F.col(c)) for c in ("a", "b")]
    found = pairs.select(
        v.cosine_from_l2(v.sq_l2(*unit)).alias("x"),
        v.dot(*unit).alias("y"),
        v.cosine(F.col("a"), F.col("b")).alias("z"),
        v.norm(unit[0]).alias("n"),
    ).collect()
    for r in found:
        assert r.x == pytest.approx(r.y, abs=1e-9) == pytest.approx(r.z, abs=1e-9)
        assert r.n == pytest.approx(1, abs=1e-12)


def test_no_direction(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    rows = df.select(
        v.has_direction(F.col("v")), v.l2_normalize(F.col("v")), v.cosine(F.col("v"), F.col("v"))
    ).collect()
    assert [r[0] for r in rows] == [True, False, False, False]
    assert [r[1] for r in rows] == [pytest.approx([0.6, 0.8]), None, None, None]
    assert [r[2] for r in rows] == [pytest.approx(1.0), None, None, None]


def test_fit_tokens(spark):
    df = spark.createDataFrame([([],), (list("abc"),), (list("abcdefgh"),)], "t array<string>")
    fitted = tk.fit_tokens(F.col("t"), 5, F.lit("E"), F.lit("P"))
    rows = df.select(fitted.alias("f")).select("f", tk.attention_mask(F.col("f"), F.lit("P")).alias("m"))
    assert [("".join(r.f), r.m) for r in rows.collect()] == [
        ("EPPPP", [1, 0, 0, 0, 0]),
        ("abcEP", [1, 1, 1, 1, 0]),
        ("abcdE", [1, 1, 1, 1, 1]),
    ]


def test_fit_tokens_by_role_and_numbers(spark):
    df = spark.createDataFrame([(list(range(2, 300)),)], "t array<int>")
    for role, n in (("query", 128), ("passage", 1024)):
        row = df.select(tk.fit_tokens_for(F.col("t"), role, F.lit(1), F.lit(0))).first()[0]
        assert len(row) == n and row[min(n - 1, 298)] == 1
    with pytest.raises(ValueError):
        tk.fit_tokens_for(F.col("t"), "title", F.lit(1), F.lit(0))
