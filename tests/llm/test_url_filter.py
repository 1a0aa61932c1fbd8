"""Exact membership for every key of the universe; rules; odd urls."""

import pytest
from pyspark.sql import functions as F

from lanternrank.llm import url_filter as u
from lanternrank.llm.queries import op3_url_filter


@pytest.mark.parametrize("segments", [1, 3])
def test_membership_is_exact(spark, monkeypatch, segments):
    monkeypatch.setattr(u, "PASS_WORDS", 1 << 20 if segments == 1 else 8)
    keys = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.createDataFrame([(None,), ("k1",)], "key string"))
    listed = spark.range(0, 6000, 7).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.createDataFrame([(None,), ("k7",)], "key string"))
    cascade = u.build(keys, listed, "key", segments)
    assert len(cascade.sizes) > 2
    got = cascade.judge(keys, "key").collect()
    assert len(got) == 6002
    assert all(r.listed == (r.key is not None and int(r.key[1:]) % 7 == 0) for r in got)


def test_segments_follow_from_the_keys(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(u, "PASS_WORDS", 4)
    rows = [(k, f"http://h{k % 700}.com/{k}" + ("?utm_a" if k % 700 < 300 else "")) for k in range(2100)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    keys = spark.createDataFrame([(f"h{k}.com",) for k in range(300)], "host string")
    cascade = u.build(keys, keys, "host")
    assert cascade.segments == 5 and max(cascade.sizes) <= 4
    got = op3_url_filter(spark, str(tmp_path)).collect()
    assert {r.page_id: r.listed for r in got} == {k: k % 700 < 300 for k, _ in rows}


def test_empty_list_and_empty_universe(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [r.listed for r in u.build(keys, keys.limit(0), "key").judge(keys, "key").collect()] == [False] * 2
    assert [r.listed for r in u.build(keys, keys, "key").judge(keys, "key").collect()] == [True] * 2
    assert u.build(keys.limit(0), keys.limit(0), "key").judge(keys.limit(0), "key").count() == 0


def test_rules_and_odd_urls(spark):
    rows = [
        (1, "http://A.Net/x", "a.net", "/x", "net/", "block"),
        (2, "https://m.example.net/en/1?q=/de/", "m.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (4, "https://example.com/de/#x", "example.com", "/de/", "example.com/de/", "block"),
        (5, "https://x.org/fr", "x.org", "/fr", None, "allow"),
        (6, "https://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        (7, None, "", "", None, "allow"), (8, "no scheme/net/", "", "", None, "allow"),
        (8, "://net", "net", "", None, "block"), (None, "a://b://c/d", "b:", "//c/d", None, "allow"),
        (9, "x://É.net?" + "y" * 100_000, "É.net", "", None, "allow"), (9, "", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(*r[:2], "h", True) for r in rows], "page_id long, url string, host string, listed boolean")
    hosts = df.select(u.host_of(F.col("url")).alias("host"))
    cascade = u.build(hosts, spark.createDataFrame([("net",)], "host string"), "host")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(df, cascade).collect()}
    assert got == {(r[0], *r[2:]) for r in rows}
    assert u.judge_urls(df, cascade).count() == len(rows)
    assert u.judge_urls(df.limit(0), cascade).count() == 0
