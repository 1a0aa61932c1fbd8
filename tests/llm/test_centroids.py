"""Bisector tournament against all distances; clusters against plain Python; odd rows."""

import hashlib
import math
import random

import numpy as np

from lanternrank.llm import centroids


def brute(rows, k=16, rounds=3, dim=64):
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)}
    first = sorted(whole, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:k]
    center = [whole[i] for i in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(center))

    for _ in range(rounds):
        of = {i: near(v)[1] for i, v in whole.items()}
        for j in range(len(center)):
            mine = [whole[i] for i in of if of[i] == j]
            if mine:
                center[j] = [sum(x) // len(mine) for x in zip(*mine)]
    final = {i: near(v) for i, v in whole.items()}
    inertia = [sum(d for d, j in final.values() if j == c) for c in range(len(center))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in center]
    return {i: (j, d, inertia[j], sum(inertia), names[j]) for i, (d, j) in final.items()}


def vector(draw, dim=64):
    return [draw.gauss(0, 0.2) for _ in range(dim)]


def test_nearest_and_ties():
    draw = np.random.default_rng(3)
    points = draw.integers(-3, 4, (17, 5))
    points[9] = points[4]
    vectors = draw.integers(-4, 5, (3000, 5))
    best, apart = centroids.Planes.of(points).nearest(vectors)
    d = ((vectors[:, None] - points) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (apart == d.min(axis=1)).all()
    assert (best != 9).all() and ((d == d.min(axis=1)[:, None]).sum(axis=1) > 1).any()


def test_large_components_are_exact():
    big = centroids.LARGEST
    points = np.array([[big] * 64, [big - 1] * 63 + [big]])
    best, apart = centroids.Planes.of(points).nearest(np.array([[big] * 64, [big - 1] * 64, [-big] * 64]))
    assert best.tolist() == [0, 1, 1] and apart.tolist() == [0, 1, 63 * (2 * big - 1) ** 2 + 4 * big**2]


def test_clusters(spark):
    draw = random.Random(11)
    rows = [(i, vector(draw)) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 600)]
    odd = [(700, None), (701, []), (702, [0.1] * 63), (703, [None] + [0.1] * 63), (704, [math.nan] + [0.1] * 63), (705, [math.inf] + [0.1] * 63), (706, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, distance int, id string").repartition(5)
    got = centroids.clusters(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute(rows + odd)


def test_columns_stay_and_rows_repeat(spark):
    draw = random.Random(2)
    rows = [(None, vector(draw)), (1, vector(draw)), (1, vector(draw)), (2, None)]
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<float>, v string")
    planes = centroids.fit(df)
    assert len(planes.centroids) == 2  # a NULL id is no seed
    out = centroids.assign(df, planes)
    assert out.columns == ["vec_id", "embedding", "v", "cluster", "distance"] and out.count() == 3
    assert centroids.clusters(df).count() == 3


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.clusters(none).count() == 0


def test_fewer_vectors_than_centroids(spark):
    draw = random.Random(4)
    rows = [(i, vector(draw)) for i in range(5)]
    got = centroids.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows)
    assert sorted(r.cluster for r in got) == [0, 1, 2, 3, 4]
