import pytest
from pyspark.sql import functions as F

import clients
from lanternrank.operators.embed import (
    Encoder,
    embed,
    embed_remote,
    encoder,
    instructed,
    register_encoder,
)

LENGTHS = Encoder("lengths", clients.load_lengths, batch_size=3)


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def test_rows_keep_their_vectors(spark):
    values = ["x" * (i % 17) for i in range(400)]
    df = texts(spark, [*values, None]).repartition(5)
    found = embed(df, "text", LENGTHS).collect()
    assert all(r.embedding is None if r.text is None else r.embedding[0] == len(r.text) for r in found)
    assert len(found) == 401


def test_model_is_loaded_once_per_worker(spark):
    df = texts(spark, ["a"] * 100).repartition(20)
    embed(df, "text", LENGTHS).count()
    assert {r.embedding[2] for r in embed(df, "text", LENGTHS).collect()} == {1.0}


def test_model_runs_once_per_row_under_a_filter(spark):
    df = embed(texts(spark, ["a", None]), "text", LENGTHS).where(F.col("embedding").isNotNull())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and df.count() == 1


def test_roles(spark):
    prompted = instructed("prompted", clients.load_lengths, batch_size=3)
    df = texts(spark, ["abc"])
    row = embed(df, "text", prompted, role="query").first()
    assert row.text == "abc" and row.embedding[0] > 80 and row.embedding[1] == 1.0
    assert embed(df, "text", prompted).first().embedding[:2] == [3.0, 0.0]
    with pytest.raises(ValueError):
        embed(df, "text", prompted, role="title")


def test_registry():
    register_encoder(Encoder("abc", clients.load_lengths))
    longer = register_encoder(Encoder("abc-large", clients.load_lengths))
    assert encoder("org/abc-large-v2") is longer
    assert encoder("abc-small").name == "abc"
    with pytest.raises(ValueError):
        encoder("org/xyz")


def ask(spark, values, **options):
    options = {"wait_connection": 0.0, "wait_other": 0.0, "max_parallel": 1, **options}
    df = embed_remote(texts(spark, values).coalesce(1), "text", clients.Flaky, **options)
    return {r.text: r for r in df.collect()}


def test_retry_then_success(spark):
    assert ask(spark, ["once", "ab"])["ab"].embedding == [2.0, 0.0]


def test_failures_are_null_with_a_reason(spark):
    found = ask(spark, ["always", "lost", "nothing", "short", "bad", "ints", "fine", None], chunk=1)
    reasons = {k: r.error for k, r in found.items() if r.embedding is None}
    assert "down" in reasons["always"] and "connection" in reasons["lost"]
    assert reasons["nothing"] == "empty response" and "0 vectors" in reasons["short"]
    assert reasons["bad"] == reasons["ints"] == "not a list of floats"
    assert reasons[None] is None and found["fine"].embedding == [4.0, 0.0]


def test_a_failed_call_fails_its_chunk_only(spark):
    found = ask(spark, ["a", "b", "always", "c", "d", "e"], chunk=2)
    assert {k for k, r in found.items() if r.embedding is None} == {"always", "c"}


def test_calls_go_round_the_endpoints(spark):
    found = ask(spark, [str(i) for i in range(6)], chunk=1, endpoints=("1", "2", "3"))
    ends = [r.embedding[1] for r in found.values()]
    assert sorted(ends) == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0]


def test_parallel_calls_are_partitions(spark):
    df = embed_remote(texts(spark, ["a"] * 50), "text", clients.Flaky, max_parallel=3)
    assert df.rdd.getNumPartitions() == 3
