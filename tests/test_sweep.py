"""Grids: even cells whatever the sizes of groups, and little repetition."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from lanternrank.operators import kernels, search, sweep
from lanternrank.operators.search import first_hit_rank, knn_join
from lanternrank.operators.sweep import GROUP, Fit, Grid, Limits, cells_of, lay_out, shuffle_tasks
from test_search import frame, items

SMALL = Limits(broadcast=0, vectors=8 * 4 * 9, state=1 << 20)
MANY = Limits(broadcast=0, vectors=8 * 4 * 9, state=1 << 20, groups=0)


def rows(spark, sizes):
    """``grp, id, embedding``: a group for each size."""
    each = [(str(g), n) for g, n in enumerate(sizes) if n]
    table = spark.createDataFrame(each or [("", 0)], f"{GROUP} string, n int").where("n > 0")
    ids = table.select(GROUP, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("id"))
    return ids.select(GROUP, F.col("id").cast("long"), F.array(F.lit(1.0)).alias("embedding"))


def work_of_cells(resident, stream, grid):
    at = cells_of(resident, stream, grid).groupBy(GROUP, "cell").agg(F.sum(1 - F.col("turn")).alias("q"), F.sum("turn").alias("p"))
    return [r.q * r.p for r in at.collect()]


@pytest.mark.parametrize("limits", [SMALL, MANY], ids=["listed", "many groups"])
@pytest.mark.parametrize(
    "q, p", [([50] * 40, [0] * 7 + [3000] + [0] * 32), ([3000] + [1] * 39, [5] * 40), ([40] * 40, [10] * 39 + [3000]), ([1] * 40, [3000] + [0] * 39)]
)
def test_no_cell_has_more_than_its_share(spark, monkeypatch, limits, q, p):
    monkeypatch.setattr(sweep, "LEAST_WORK", 64)
    resident, stream = rows(spark, q), rows(spark, p)
    grid = lay_out(resident, stream, Fit(1000, False), limits)
    work = work_of_cells(resident, stream, grid)
    total = sum(a * b for a, b in zip(q, p))
    tasks = sweep.TASKS_PER_CORE * shuffle_tasks(resident)
    assert sum(work) == total  # every pair once
    assert max(work) <= 2 * total / tasks + 64
    if limits is SMALL:
        assert grid.cells <= 3 * tasks + 40


def test_blocks_fit_in_memory(spark):
    resident, stream = rows(spark, [5000]), rows(spark, [3])
    grid = lay_out(resident, stream, Fit(100, False), SMALL)
    held = cells_of(resident, stream, grid).where("turn = 0").groupBy("cell").count()
    assert grid.groups.first().blocks == 50 and max(r["count"] for r in held.collect()) < 200


def test_grids_repeat_few_rows(spark, monkeypatch):
    monkeypatch.setattr(sweep, "LEAST_WORK", 1)
    q, p = rows(spark, [100]), rows(spark, [10_000])
    grid = lay_out(q, p, Fit(1000, False), SMALL)
    n = cells_of(q, p, grid).count()
    cells = sweep.TASKS_PER_CORE * shuffle_tasks(q)
    assert n <= min(100 * -(-cells // b) + 10_000 * b for b in range(1, cells + 1)) * 1.2


def test_groups_without_a_partner_take_no_part(spark):
    resident, stream = rows(spark, [5, 0, 7]), rows(spark, [0, 9, 4])
    grid = lay_out(resident, stream, Fit(1000, False), SMALL)
    assert {r[GROUP] for r in cells_of(resident, stream, grid).select(GROUP).distinct().collect()} == {"2"}
    none = lay_out(resident, stream.where("id < 0"), Fit(1000, False), SMALL)
    assert isinstance(none, Grid) and none.cells == 0


@pytest.mark.parametrize("limits", [Limits(), SMALL, MANY], ids=["broadcast", "grid", "grid, many groups"])
def test_one_group_owns_all_passages(spark, monkeypatch, limits):
    monkeypatch.setattr(sweep, "LEAST_WORK", 16)
    q, p = items(80, 21), items(300, 22)
    asked = frame(spark, q).withColumn("part", (F.col("id") % 8).cast("string"))
    offered = frame(spark, p).withColumn("part", F.lit("3"))
    mine = np.flatnonzero(q[0] % 8 == 3)
    found = knn_join(asked, offered, 5, by="part", limits=limits).collect()
    orders = brute.orders(q[2], p[2], p[0])
    want = {(int(q[0][n]), k): int(p[0][at]) for n in mine for k, at in enumerate(orders[n][:5], 1)}
    assert {(r.query_id, r["rank"]): r.passage_id for r in found} == want
    ranks = {r.query_id: r["rank"] for r in first_hit_rank(asked, offered, by="part", limits=limits).collect()}
    hits = brute.first_hits(q[2], q[1], p[2], p[0], p[1])
    assert ranks == {int(i): hits[n] or None if n in mine else None for n, i in enumerate(q[0])}


@pytest.mark.parametrize("limits", [SMALL, MANY], ids=["grid", "grid, many groups"])
@pytest.mark.parametrize("pairs", [1, 500, 1 << 20])
def test_hot_keys(spark, monkeypatch, limits, pairs):
    monkeypatch.setattr(search, "KEY_PAIRS", pairs)
    monkeypatch.setattr(sweep, "LEAST_WORK", 16)
    q, p = items(60, 31, keys=5), items(240, 32, keys=4)
    q = (q[0], [None if n % 11 == 0 else k for n, k in enumerate(q[1])], q[2])
    p = (p[0], [None if n % 7 == 0 else 'k"0' if k == "k0" else k for n, k in enumerate(p[1])], p[2])
    q = (q[0], ['k"0' if k == "k0" else k for k in q[1]], q[2])
    ranks = {r.query_id: r["rank"] for r in first_hit_rank(frame(spark, q), frame(spark, p), limits=limits).collect()}
    want = brute.first_hits(q[2], [k or "none" for k in q[1]], p[2], p[0], [k or "nothing" for k in p[1]])
    assert ranks == {int(i): r or None for i, r in zip(q[0], want)}


def test_gold_answers_without_a_second_sweep(spark):
    plan = first_hit_rank(frame(spark, items(40, 1)), frame(spark, items(90, 2)), limits=SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # One sweep counts; the answers come from an equi-join.
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" in plan


def test_passing_rows_are_repeated_for_few_blocks(spark):
    resident, stream = rows(spark, [5000]), rows(spark, [900])
    grid = lay_out(resident, stream, Fit(5, False), SMALL)
    sent = cells_of(resident, stream, grid)
    # Before: a block for every five rows, and 900,000 passing rows.
    assert sent.where("turn = 1").count() <= 64 * 900 and sent.where("turn = 0").count() <= 5000 * 17


def test_few_stripes_if_each_returns_much(spark, monkeypatch):
    monkeypatch.setattr(sweep, "LEAST_WORK", 1)
    q, p = rows(spark, [400]), rows(spark, [400])
    usual, much = (lay_out(q, p, Fit(1000, False), SMALL, returned) for returned in (0, 32_000))
    assert usual.groups.first().stripes == 4 and much.groups.first().stripes == 1
    assert usual.cells == much.cells == 16


@pytest.mark.parametrize("step", [3, 7, 100])
@pytest.mark.parametrize("held", [1, 4, 33, 1000])
def test_rounds_give_what_one_block_does(step, held):
    q, p = items(40, 51), items(90, 52)
    table = lambda d: pa.table(
        {"grp": [""] * len(d[0]), "id": d[0], "embedding": pa.array(d[2].tolist(), pa.list_(pa.float32()))}
    )

    def found(work):
        for turn, side in enumerate((q, p)):
            for batch in table(side).to_batches(max_chunksize=step):
                work.take(turn, batch)
        return sorted(tuple(r.values()) for b in work.result() for r in b.to_pylist())

    made = []

    class Counted(kernels.TopK):
        def start(self, resident):
            made.append(len(resident))
            super().start(resident)

    assert found(sweep.Rounds(lambda: Counted(5), held)) == found(kernels.TopK(5))
    assert sum(made) == 40 and max(made) <= max(1, held + held // 4)
    assert found(sweep.Rounds(lambda: kernels.TopK(5), 1000)) == found(kernels.TopK(5))


def test_rounds_without_a_stream_return_nothing():
    batch = pa.record_batch({"grp": ["", ""], "id": [1, 2], "embedding": pa.array([[1.0], [1.0]], pa.list_(pa.float32()))})
    work = sweep.Rounds(lambda: kernels.TopK(5), 1)
    work.take(0, batch)
    assert list(work.result()) == []


def test_cells_follow_the_cores(spark, monkeypatch):
    # Before, 4 x 200 cells, each row repeated for 28 of them.
    monkeypatch.setattr(sweep, "LEAST_WORK", 1)
    resident, stream = rows(spark, [1000]), rows(spark, [1000])
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        grid = lay_out(resident, stream, Fit(1000, False), SMALL)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert grid.cells <= 4 * max(8, spark.sparkContext.defaultParallelism) + 8
