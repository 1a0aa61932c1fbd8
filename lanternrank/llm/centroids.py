"""Clusters of vectors around centroids, in whole numbers.

A vector is nearer to one of two centroids by the side of their bisecting plane
that it is on. For each pair of centroids the plane's normal and threshold are
whole numbers computed once, so a vector finds its nearest of k centroids by a
tournament of k - 1 sign tests: the winner so far meets the next centroid, and
the loser is out. A test that gives zero is a tie and goes to the smaller
number. Only the winner's distance is computed. All arithmetic is exact, so
clusters do not depend on the layout of the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.shared import part_files

K = 16
ROUNDS = 3
DIM = 64
SCALE = 64
SEED = 1
# Whole numbers beyond this could overflow a squared distance of 64 components.
LARGEST = 1 << 26
# Rows of vectors that a task tests at once.
ROWS = 4096


@dataclass(frozen=True)
class Planes:
    """For centroids a < b: x is nearer to b if ``normal[a, b] @ x > threshold[a, b]``."""

    centroids: np.ndarray
    normal: np.ndarray
    threshold: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Planes:
        normal = 2 * (centroids[None, :, :] - centroids[:, None, :])
        norms = np.einsum("ij,ij->i", centroids, centroids)
        return cls(centroids, normal, norms[None, :] - norms[:, None])

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, and the squared distance to it."""
        best = np.zeros(len(vectors), np.int64)
        for b in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", vectors, self.normal[best, b]) - self.threshold[best, b]
            best[side > 0] = b
        apart = vectors - self.centroids[best]
        return best, np.einsum("ij,ij->i", apart, apart)


def usable(vector: str | Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """Vectors that take part: ``dim`` components, none NULL, NaN or infinite,
    and none so large that a squared distance might not fit a long."""
    v = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float(LARGEST // scale))))
    return F.coalesce((F.size(v) == dim) & good, F.lit(False))


def _whole(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Rows of whole numbers; the column has no NULL."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(-1, dim)


def kept(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(usable("v", dim, scale))


def seeds(rows: DataFrame, k: int, seed: int, dim: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest digests of their ids, fewer if there are
    fewer; rows with a NULL id are none. Of rows with one id, by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    found = np.array([r.v for r in first], np.float64).reshape(-1, dim)
    return np.floor(scale * found).astype(np.int64)


def _sums(rows: DataFrame, planes: Planes, dim: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """For each cluster its number of vectors and their sum.

    A task adds up what it reads and passes on one row for each cluster; those
    are added by component. k x dim numbers come to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(planes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shared.value.centroids), dim + 1), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                vectors = _whole(batch.column(0).slice(lo, ROWS), dim, scale)
                best, _ = shared.value.nearest(vectors)
                order = np.argsort(best, kind="stable")
                some, start = np.unique(best[order], return_index=True)
                total[some, :dim] += np.add.reduceat(vectors[order], start, axis=0)
                total[some, dim] += np.diff(np.append(start, len(best)))
        used = np.flatnonzero(total[:, dim])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dim + 1)), pa.array(np.tile(np.arange(dim + 1), len(used))), pa.array(total[used].ravel())],
            ["cluster", "place", "total"],
        )

    parts = rows.select("v").mapInArrow(add, "cluster long, place long, total long")
    found: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()):
        counts = found.setdefault(row.cluster, (0, []))[1]
        counts.append(row.total)
    return {c: (x[dim], x[:dim]) for c, (_, x) in found.items()}


def fit(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE,
) -> Planes:
    """Centroids after so many rounds over all vectors; empty clusters stay
    where they are. Without a usable vector there are none."""
    rows = kept(vectors, id_col, vector_col, dim, scale)
    centroids = seeds(rows, k, seed, dim, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for c, (n, total) in _sums(rows, Planes.of(centroids), dim, scale).items():
            centroids[c] = [x // n for x in total]
    return Planes.of(centroids)


def assign(
    vectors: DataFrame, planes: Planes, vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """The usable rows of ``vectors`` with ``cluster`` and ``distance`` (squared).
    Columns of these names are replaced, all others stay; repeated rows stay."""
    dim = planes.centroids.shape[1]
    held = vectors.select(
        F.struct(*[F.col(c) for c in vectors.columns if c not in ("cluster", "distance")]).alias("row"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    held = held.where(usable("v", dim, scale)) if len(planes.centroids) else held.limit(0)
    shared = vectors.sparkSession.sparkContext.broadcast(planes)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [shared.value.nearest(_whole(batch.slice(lo, ROWS), dim, scale)) for lo in range(0, len(batch), ROWS)]
            best, distance = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in (0, 1))
            yield pa.StructArray.from_arrays([pa.array(best.astype(np.int32)), pa.array(distance)], ["cluster", "distance"])

    near = F.arrow_udf(run, "cluster int, distance long").asNondeterministic()
    return held.select("row", near("v").alias("near")).select("row.*", "near.*")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE,
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of
    every usable vector. Rows with a NULL id are clustered, but are no seeds.

    A vector is not usable with another number of components than ``dim``, with
    one that is NULL, NaN, infinite, or not below 2**26 / ``scale`` in size;
    such rows are left out. Other columns are left out as well.
    """
    planes = fit(vectors, id_col, vector_col, k, rounds, seed, dim, scale)
    near = assign(vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")), planes, "_v", scale)
    near = part_files(near.select("_id", "cluster", "distance"), "clusters")
    sums = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in sums)
    table = [(r.cluster, r.cluster_inertia, total, digest(planes.centroids[r.cluster])) for r in sums]
    told = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = near.join(F.broadcast(told), "cluster")  # at most k rows
    return out.select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
