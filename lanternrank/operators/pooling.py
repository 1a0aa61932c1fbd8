"""Token states to one vector per sequence.

Token states are a long table ``(seq_id, layer, pos, hidden array<float>,
mask)``; mask 0 is padding, on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick_layer(states: DataFrame, layer: int = -1, layers: int | None = None) -> DataFrame:
    """States of one layer; negative numbers count from the last one.

    ``layers`` is the number of layers, if known; else it is looked up in the
    table by a subquery over the ``layer`` column alone.
    """
    if layer >= 0:
        wanted = F.lit(layer)
    elif layers is not None:
        wanted = F.lit(layers + layer)
    else:
        wanted = states.agg(F.max("layer") + (1 + layer)).scalar()
    return states.where(F.col("layer") == wanted).drop("layer")


def _edge(states: DataFrame, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    real = F.col("mask") == 1
    chosen = pick(F.when(real, F.col("hidden")), F.when(real, F.col("pos")))
    return states.groupBy("seq_id").agg(chosen.cast("array<double>").alias("embedding"))


SALTS = 64           # parts in which a sequence's partial sums are merged first
HELD_VALUES = 1 << 20  # components of partial sums that a task holds


def _rows(column: pa.Array) -> np.ndarray:
    """A list column without NULLs as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _sums(ids: pa.Array, totals: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each id; without real tokens (count 0) the vector is empty."""
    ends = np.cumsum(np.r_[0, np.where(counts > 0, totals.shape[1], 0)]).astype(np.int32)
    parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(totals[counts > 0].ravel()))
    return pa.RecordBatch.from_arrays([ids, parts, pa.array(counts)], ["seq_id", "total", "n"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the real tokens that a task reads, sequence by sequence; what it
    holds is passed on when it grows beyond HELD_VALUES."""
    held: dict = {}
    kind, size = None, 0

    def told() -> pa.RecordBatch:
        some = [k for k, (_, n) in held.items() if n]
        none = [k for k, (_, n) in held.items() if not n]
        totals = np.stack([held[k][0] for k in some]) if some else np.zeros((0, 0))
        counts = np.array([held[k][1] for k in some] + [0] * len(none), np.int64)
        whole = np.concatenate([totals, np.zeros((len(none), totals.shape[1]))])
        return _sums(pa.array(some + none, kind), whole, counts)

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field(0).type
        ids = batch.column(0).dictionary_encode()
        at = ids.indices.to_numpy()
        real = batch.column(2).to_numpy(zero_copy_only=False) == 1
        real &= batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        counts = np.bincount(at[real], minlength=len(ids.dictionary))
        vectors = _rows(batch.column(1).filter(pa.array(real)))
        total = np.zeros((len(counts), vectors.shape[1]))
        np.add.at(total, at[real], vectors)
        for k, key in enumerate(ids.dictionary.to_pylist()):
            before, n = held.get(key, (None, 0))
            if counts[k]:
                held[key] = (total[k] if before is None else before + total[k], n + int(counts[k]))
                size += len(total[k]) if before is None else 0
            else:
                held.setdefault(key, (None, 0))
        if size > HELD_VALUES or len(held) > HELD_VALUES:
            yield told()
            held, size = {}, 0
    if held:
        yield told()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up runs of rows of one sequence, in sorted order: one running sum is
    all that is kept from batch to batch."""
    last, total, count, kind = None, None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field(0).type
        counts = batch.column(2).to_numpy(zero_copy_only=False)
        real = counts > 0
        keys = batch.column(0).to_pylist()
        vectors = _rows(batch.column(1).filter(pa.array(real)))
        place = np.cumsum(real) - real
        new = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for lo, hi in zip(new, new[1:]):
            if last is None or keys[lo] != last[0]:
                if last is not None:
                    yield _one(last[0], total, count, kind)
                last, total, count = (keys[lo],), None, 0
            mine = vectors[place[lo] : place[lo] + int(real[lo:hi].sum())]
            if len(mine):
                total = mine.sum(axis=0) if total is None else total + mine.sum(axis=0)
                count += int(counts[lo:hi].sum())
    if last is not None:
        yield _one(last[0], total, count, kind)


def _one(key: object, total: np.ndarray | None, count: int, kind: pa.DataType) -> pa.RecordBatch:
    vector = np.zeros((1, 0)) if total is None else total[None, :]
    return _sums(pa.array([key], kind), vector, np.array([count], np.int64))


def _mean(states: DataFrame) -> DataFrame:
    """Sums merge as a tree: within a task, then within a part of a sequence's
    partial sums, then for the sequence. No row holds more than one vector, and
    the partial sums of a sequence that all tasks see do not meet in one task."""
    kind = states.schema["seq_id"].dataType.simpleString()
    schema = f"seq_id {kind}, total array<double>, n long"
    rows = states.select("seq_id", F.col("hidden").cast("array<double>"), F.col("mask").cast("int"))
    parts = rows.mapInArrow(_partial, schema)
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    salted = parts.withColumn("salt", salt).repartition("seq_id", "salt").sortWithinPartitions("seq_id", "salt")
    merged = salted.select("seq_id", "total", "n").mapInArrow(_merge, schema)
    whole = merged.repartition("seq_id").sortWithinPartitions("seq_id").mapInArrow(_merge, schema)
    mean = F.transform("total", lambda x: x / F.col("n"))
    return whole.select("seq_id", F.when(F.col("n") > 0, mean).alias("embedding"))


def pool(states: DataFrame, strategy: str = "last") -> DataFrame:
    """``seq_id, embedding`` from the last or first real token, or their mean;
    a sequence of padding only has a NULL vector."""
    if strategy in ("last", "first"):
        return _edge(states, last=strategy == "last")
    if strategy == "mean":
        return _mean(states)
    raise ValueError(f"pooling strategy must be last, first or mean, not {strategy!r}")
