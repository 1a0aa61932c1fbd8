import pytest

from lanternrank.operators.pooling import pick_layer, pool

SCHEMA = "seq_id bigint, layer int, pos int, hidden array<float>, mask int"


@pytest.fixture
def states(spark):
    rows = []
    masks = {1: [0, 0, 1, 1], 2: [1, 1, 1, 0], 3: [1, 1, 1, 1], 4: [0, 0, 0, 0]}
    for seq, mask in masks.items():
        for pos, bit in enumerate(mask):
            for layer in (0, 1, 2):
                rows.append((seq, layer, pos, [float(10 * seq + pos), float(layer)], bit))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pooled(states, strategy, layer=-1, **options):
    return {r.seq_id: r.embedding for r in pool(pick_layer(states, layer, **options), strategy).collect()}


def test_strategies_on_either_padding(states):
    assert pooled(states, "last") == {1: [13.0, 2.0], 2: [22.0, 2.0], 3: [33.0, 2.0], 4: None}
    assert pooled(states, "first") == {1: [12.0, 2.0], 2: [20.0, 2.0], 3: [30.0, 2.0], 4: None}
    assert pooled(states, "mean") == {1: [12.5, 2.0], 2: [21.0, 2.0], 3: [31.5, 2.0], 4: None}


def test_layers(states):
    assert pooled(states, "last", 0)[1] == [13.0, 0.0]
    assert pooled(states, "last", -3)[1] == [13.0, 0.0]
    assert pooled(states, "last", -2, layers=3)[1] == [13.0, 1.0]


def test_unknown_strategy(states):
    with pytest.raises(ValueError):
        pool(states, "max")


def test_a_sequence_that_holds_most_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lanternrank.operators import pooling

    monkeypatch.setattr(pooling, "HELD_VALUES", 8)
    monkeypatch.setattr(pooling, "SALTS", 3)
    rows = spark.range(6000, numPartitions=12).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).cast("string").alias("seq_id"),
        F.lit(0).alias("layer"), F.col("id").alias("pos"),
        F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(None).cast("double")).alias("hidden"), F.lit(1).alias("mask"),
    ).withColumn("hidden", F.slice("hidden", 1, 2))
    parts = rows.select("seq_id", F.col("hidden"), F.col("mask")).mapInArrow(pooling._partial, "seq_id string, total array<double>, n long")
    assert parts.where(F.size("total") > 2).count() == 0 and parts.where("seq_id = '7'").count() >= 12
    got = {r.seq_id: r.embedding for r in pool(rows, "mean").collect()}
    want = {r.seq_id: [r.m, 1.0] for r in rows.groupBy("seq_id").agg(F.avg(F.col("hidden")[0]).alias("m")).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
