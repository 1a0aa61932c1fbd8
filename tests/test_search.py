import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from lanternrank.operators import kernels, search
from lanternrank.operators.search import first_hit_rank, first_hits, knn_join
from lanternrank.operators.sweep import Limits

# The broadcast layout; blocks and stripes; and group sizes left to Spark.
LAYOUTS = {
    "broadcast": Limits(),
    "grid": Limits(broadcast=0, vectors=8 * 4 * 9, state=1 << 20),
    "grid, keys broadcast": Limits(broadcast=60_000, vectors=8 * 4 * 9, state=1 << 20),
    "grid, many groups": Limits(broadcast=0, vectors=8 * 4 * 9, state=1 << 20, groups=0),
}
SCHEMA = "id bigint, key string, embedding array<float>"


def items(n, seed, dim=4, keys=9):
    """Vectors of which a third are copies of one, and keys of which one is hot."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, size=(n, dim)).astype(float)
    x[~x.any(axis=1)] = 1.0
    x[: n // 3] = 1.0
    k = [f"k{i}" for i in np.where(rng.random(n) < 0.3, 0, rng.integers(0, keys, n))]
    ids = rng.permutation(n * 3)[:n]
    return ids.astype(np.int64), k, x


def frame(spark, data):
    ids, keys, x = data
    rows = [(int(i), k, v.tolist()) for i, k, v in zip(ids, keys, x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("k, pilot", [(1, False), (500, False), (7, True)])
def test_knn_equals_brute_force(spark, layout, k, pilot, monkeypatch):
    monkeypatch.setattr(search, "PILOT", 4)
    q, p = items(40, 1), items(170, 2)
    found = knn_join(
        frame(spark, q), frame(spark, p), k, limits=LAYOUTS[layout], pilot=pilot
    ).collect()
    got = {(r.query_id, r["rank"]): (r.passage_id, round(r.score * 1e9)) for r in found}
    want = {}
    score = brute.ticks(q[2], p[2])
    for n, order in enumerate(brute.orders(q[2], p[2], p[0])):
        for rank, at in enumerate(order[:k], 1):
            want[int(q[0][n]), rank] = (int(p[0][at]), int(score[n, at]))
    assert got == want and len(found) == len(want)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("depth", [1000, 20])
def test_first_hit_equals_brute_force(spark, layout, depth):
    q, p = items(60, 3, keys=40), items(150, 4, keys=30)
    ranks = first_hit_rank(frame(spark, q), frame(spark, p), depth, limits=LAYOUTS[layout])
    got = {r.query_id: r["rank"] for r in ranks.collect()}
    want = brute.first_hits(q[2], q[1], p[2], p[0], p[1])
    assert got == {int(i): r if r and r <= depth else None for i, r in zip(q[0], want)}
    assert None in got.values() and 1 < max(r for r in got.values() if r)


def test_searched_neighbours_give_the_same_ranks(spark):
    q, p = (frame(spark, items(60, 3, keys=40)), frame(spark, items(150, 4, keys=30)))
    counted = first_hit_rank(q, p, 25).orderBy("query_id").collect()
    searched = first_hits(knn_join(q, p, 25), q, p).orderBy("query_id").collect()
    assert counted == searched


@pytest.mark.parametrize("layout", LAYOUTS)
def test_groups_do_not_mix(spark, layout):
    parts = [(frame(spark, items(30, s)), frame(spark, items(80, s + 50))) for s in (1, 2)]
    tag = lambda df, n: df.withColumn("dataset", F.lit(f"d{n}"))
    q = p = None
    for n, (a, b) in enumerate(parts):
        q = tag(a, n) if q is None else q.unionByName(tag(a, n))
        p = tag(b, n) if p is None else p.unionByName(tag(b, n))
    q, p = q.repartition(2), p.repartition(2)  # groups interleaved
    limits = LAYOUTS[layout]
    near = knn_join(q, p, 4, by="dataset", limits=limits).collect()
    ranks = first_hit_rank(q, p, by="dataset", limits=limits).collect()
    for n, (a, b) in enumerate(parts):
        alone = knn_join(a, b, 4).collect()
        assert sorted(r[1:] for r in near if r.dataset == f"d{n}") == sorted(alone)
        alone = first_hit_rank(a, b).collect()
        assert sorted(r[1:3] + (r["rank"] or 0,) for r in ranks if r.dataset == f"d{n}") == sorted(
            r[:2] + (r["rank"] or 0,) for r in alone
        )


def test_vectors_without_direction(spark):
    q = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "a", None), (3, "a", [1.0, 0.0])], SCHEMA)
    p = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.0])], SCHEMA)
    assert {r.query_id: r["rank"] for r in first_hit_rank(q, p).collect()} == {1: None, 2: None, 3: 2}
    assert [tuple(r) for r in knn_join(q, p, 5).orderBy("rank").collect()] == [
        (3, 3, 1.0, 1), (3, 2, 0.0, 2),
    ]


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], SCHEMA), frame(spark, items(5, 1))
    assert knn_join(none, some).count() == knn_join(some, none).count() == 0
    assert first_hit_rank(none, some).count() == 0
    assert [r["rank"] for r in first_hit_rank(some, none).collect()] == [None] * 5


def test_bad_arguments(spark):
    some = frame(spark, items(5, 1))
    with pytest.raises(ValueError):
        knn_join(some, some, 0)
    with pytest.raises(TypeError):
        knn_join(some.withColumn("id", F.col("id").cast("string")), some)


def test_vectors_of_different_length_are_refused(spark):
    p = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0, 0.0, 1.0])], SCHEMA)
    q = spark.createDataFrame([(1, "a", [1.0, 0.0])], SCHEMA)
    with pytest.raises(Exception, match="differ in length"):
        knn_join(q, p.coalesce(1), 1).collect()


def test_scale_of_vectors_does_not_matter(spark):
    q, p = items(20, 5), items(60, 6)
    big = (p[0], p[1], p[2] * 37.5)
    a = knn_join(frame(spark, q), frame(spark, p), 6).collect()
    assert sorted(a) == sorted(knn_join(frame(spark, q), frame(spark, big), 6).collect())


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 60), st.integers(1, 9))
def test_top_k_kernel_over_any_batches(seed, k, n, step):
    import pyarrow as pa

    q, p = items(12, seed), items(n, seed + 1)
    old, kernels._PENDING = kernels._PENDING, 3
    try:
        work = kernels.TopK(k)
        table = lambda d: pa.table(
            {"grp": [""] * len(d[0]), "id": d[0], "embedding": pa.array(d[2].tolist(), pa.list_(pa.float32()))}
        )
        for batch in table(q).to_batches():
            work.take(0, batch)
        for batch in table(p).to_batches(max_chunksize=step):
            work.take(1, batch)
        rows = pa.Table.from_batches(list(work.result())).to_pylist()
    finally:
        kernels._PENDING = old
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["passage_id"])
    want = {
        int(i): {int(p[0][a]) for a in order[:k]}
        for i, order in zip(q[0], brute.orders(q[2], p[2], p[0]))
    }
    assert got == want


@pytest.mark.parametrize("dim", [4, 64])
def test_best_match_of_hot_keys(monkeypatch, dim):
    """Few keys of many rows: scored in tiles, with the same answers, ties by id,
    and without a row for each pair."""
    q, p = items(300, 21, dim, keys=3), items(900, 22, dim, keys=3)
    monkeypatch.setattr(kernels, "_COLUMNS", 128)
    monkeypatch.setattr(kernels, "_MANY_PAIRS", 64)
    singly = []
    monkeypatch.setattr(kernels.BestMatch, "_score", lambda self, codes, *rest: singly.append(len(codes)))
    kernel = kernels.BestMatch()
    kernel.start(pa.table({"grp": [""] * 300, "id": q[0], "key": q[1], "embedding": list(q[2])}))
    table = pa.table({"id": p[0], "key": p[1], "embedding": list(p[2])})
    for batch in table.to_batches(max_chunksize=300):
        kernel.feed(batch)
    got = pa.Table.from_batches(list(kernel.finish())).to_pylist()
    score = brute.ticks(q[2], p[2])
    want = {}
    for n, order in enumerate(brute.orders(q[2], p[2], p[0])):
        at = next(at for at in order if p[1][at] == q[1][n])
        want[int(q[0][n])] = (int(p[0][at]), int(score[n, at]))
    assert {r["query_id"]: (r["gold_id"], r["gold_ticks"]) for r in got} == want
    assert sum(singly) == 0


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_counting_looks_at_few_or_at_all(monkeypatch, few):
    """Both ways of a tile count what is ahead; only near ones are looked at again."""
    monkeypatch.setattr(kernels, "_FEW_AHEAD", few)
    q, p = items(120, 23, 16), items(700, 24, 16)
    score = brute.ticks(q[2], p[2])
    orders = brute.orders(q[2], p[2], p[0])
    gold = [order[n * 5] for n, order in enumerate(orders)]
    kernel = kernels.CountAhead()
    kernel.start(pa.table({
        "grp": [""] * 120, "id": q[0], "embedding": list(q[2]),
        "gold_ticks": [int(score[n, at]) for n, at in enumerate(gold)], "gold_id": [int(p[0][at]) for at in gold],
    }))
    for batch in pa.table({"id": p[0], "embedding": list(p[2])}).to_batches(max_chunksize=256):
        kernel.feed(batch)
    assert kernel.ahead.tolist() == [n * 5 for n in range(120)]
