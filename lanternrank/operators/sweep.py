"""Exact all-against-all scoring without a cross join.

Exact search compares every query with every candidate. The comparisons are
matrix products, done block against block inside tasks; what leaves a task is
one partial result per query (a top-k list, a best match, a count), never the
pairs. Partial results merge in an ordinary aggregate or window.

One side is *resident*: a task holds a bounded block of it. The other side
*streams* past in Arrow batches. Two layouts do the same work:

* if the resident side is measured to fit one task, it is broadcast and the
  stream is read where it lies, without a shuffle;
* otherwise both sides are cut by a hash of the row id into blocks and stripes
  and meet in (block, stripe) cells through one shuffle. Ids are unique, so
  cells are even whatever the keys or labels look like.

How a group is cut follows from both of its sizes: into as many cells as its
share of all comparisons asks for, and of all grids with so many cells the one
that repeats and returns the fewest rows. So one group that owns most passages, or
most queries, is cut like any other, and a group of few comparisons is one cell.
Passing rows are repeated for so many blocks at most; a block that is still too
large for memory is worked on in rounds, for which its stripe is kept in a file.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternrank.functions.vectors import has_direction
from lanternrank.sources.records import materialize

GROUP = "grp"
TASKS_PER_CORE = 4  # relative to shuffle_tasks
LEAST_WORK = 1 << 18  # comparisons that are worth a cell of their own
MOST_BLOCKS = 64      # blocks that passing rows are repeated for because of memory


@dataclass(frozen=True)
class Limits:
    """Memory bounds, in bytes unless said otherwise."""

    broadcast: int = 64 << 20      # largest resident side that is broadcast
    vectors: int = 64 << 20        # resident vectors held by one task
    state: int = 256 << 20         # partial results held by one task
    groups: int = 10_000           # group or label sizes read by the driver (rows)
    broadcast_groups: int = 64     # groups told apart within one task (rows)


@dataclass(frozen=True)
class Fit:
    """Measured size of a resident side, and what follows from it."""

    rows_per_block: int
    broadcast: bool
    empty: bool = False
    broadcast_keys: bool = False    # the keys alone are small, if not the vectors
    row_bytes: int = 320            # of a row that is shuffled, about


@dataclass(frozen=True)
class Grid:
    """How groups are cut: ``grp, blocks, stripes, start`` of the listed ones.

    ``start`` is the number of the group's first cell. Groups that are not
    listed are one cell each if ``others``, and else have nothing to compare.
    """

    groups: DataFrame
    cells: int | None               # None: not all groups are listed
    others: bool
    small: bool                     # the list has been read, so its size is known
    only: tuple | None = None       # the list, if it is one group


def side(df: DataFrame, by: str | None, *extra: Column) -> DataFrame:
    """Rows that can be scored: group, id, embedding and the extra columns.

    NULL and zero vectors have no direction; they are no candidates, and as
    queries they find nothing.
    """
    if not isinstance(df.schema["id"].dataType, T.LongType):
        raise TypeError("column id must be a bigint, unique within its group")
    group = F.col(by).cast("string") if by else F.lit("")
    return df.where(has_direction(F.col("embedding"))).select(
        group.alias(GROUP), "id", "embedding", *extra
    )


def measure(resident: DataFrame, state_per_row: int, limits: Limits = Limits()) -> Fit:
    """Count the resident side (one small job) and choose the layout."""
    key = F.coalesce(F.octet_length("key"), F.lit(0)) if "key" in resident.columns else F.lit(0)
    sizes = resident.groupBy(GROUP).agg(
        F.count("*").alias("n"),
        F.max(F.size("embedding")).alias("dim"),
        F.sum(4 * F.size("embedding")).alias("vector_bytes"),
        F.sum(key + 32).alias("key_bytes"),  # as entries of a hash table
    )
    rows = sizes.limit(limits.groups + 1).collect()
    known = len(rows) <= limits.groups
    if known:
        dim = max((r["dim"] for r in rows), default=1)
    else:
        dim = sizes.agg(F.max("dim")).first()[0]
    fits = max(1, min(limits.vectors // (8 * dim), limits.state // max(1, state_per_row)))
    row_bytes = 4 * dim + 64
    if not known:
        return Fit(fits, False, row_bytes=row_bytes)
    key_bytes = sum(r["key_bytes"] for r in rows)
    small = (
        len(rows) <= limits.broadcast_groups
        and sum(r["n"] for r in rows) <= fits
        and sum(r["vector_bytes"] for r in rows) + key_bytes <= limits.broadcast
    )
    return Fit(fits, small, not rows, key_bytes <= limits.broadcast, row_bytes)


def _cut(sizes: DataFrame, work: int, tasks: int, rows_per_block: int, returned: float = 0.0) -> DataFrame:
    """``grp, blocks, stripes`` for groups of ``q`` resident and ``p`` passing rows.

    Every resident row is repeated for each stripe, which also returns as much as
    ``returned`` rows for it, and every passing row for each block. With b blocks
    and s stripes that is q*s*(1 + returned) + p*b rows, least for b*s = c cells at
    b = sqrt(q*c*(1 + returned)/p). A block also has to fit in memory, unless
    that takes more than MOST_BLOCKS.
    """
    most = max(LEAST_WORK, -(-work // tasks))
    q, p = F.col("q").cast("double"), F.col("p").cast("double")
    cells = F.greatest(F.ceil(q * p / most), F.lit(1))
    least = F.least(F.greatest(F.ceil(q / rows_per_block), F.lit(1)), F.lit(MOST_BLOCKS))
    ideal = F.round(F.sqrt(q * cells * (1 + returned) / p)).cast("long")
    blocks = F.least(F.greatest(least, F.least(ideal, cells)), F.greatest(least, F.col("q")))
    cut = sizes.where("q > 0 and p > 0").select(GROUP, "q", "p", cells.alias("cells"), blocks.alias("blocks"))
    stripes = F.least(F.ceil(F.col("cells") / F.col("blocks")), F.col("p"))
    return cut.select(GROUP, F.col("blocks").cast("int").alias("blocks"), stripes.cast("int").alias("stripes"), "q", "p")


def _listed(spark: SparkSession, cut: list[Row], others: bool) -> Grid:
    """The groups with their first cells, those with the largest cells first."""
    cut = sorted(cut, key=lambda r: (-r["q"] * r["p"] / (r["blocks"] * r["stripes"]), r[GROUP]))
    rows, start = [], 0
    for r in cut:
        rows.append((r[GROUP], r["blocks"], r["stripes"], start))
        start += r["blocks"] * r["stripes"]
    table = spark.createDataFrame(rows, f"{GROUP} string, blocks int, stripes int, start long")
    only = rows[0] if len(rows) == 1 and not others else None
    return Grid(table, None if others else start, others, True, only)


def lay_out(
    resident: DataFrame, stream: DataFrame, fit: Fit, limits: Limits = Limits(), returned: int = 0
) -> Grid:
    """Count both sides by group and decide the grid. ``returned`` are the bytes
    that a stripe returns for a resident row.

    Up to ``limits.groups`` groups are planned one by one, and their cells are
    numbered without gaps. Of more groups only those of several cells are
    listed: each has more than a task's share of all comparisons, or more than a
    block of queries, so they are few; should they not be, they stay a table.
    """
    spark = resident.sparkSession
    tasks = TASKS_PER_CORE * shuffle_tasks(resident)
    share = returned / fit.row_bytes
    both = resident.select(GROUP, F.lit(1).alias("q"), F.lit(0).alias("p")).unionAll(stream.select(GROUP, F.lit(0), F.lit(1)))
    sizes = both.groupBy(GROUP).agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    rows = sizes.limit(limits.groups + 1).collect()
    if len(rows) <= limits.groups:
        work = sum(r["q"] * r["p"] for r in rows)
        known = spark.createDataFrame(rows, sizes.schema)
        return _listed(spark, _cut(known, work, tasks, fit.rows_per_block, share).collect(), False)
    sizes = materialize(sizes, "group-sizes")
    work = int(sizes.agg(F.sum(F.col("q").cast("double") * F.col("p"))).first()[0])
    cut = _cut(sizes, work, tasks, fit.rows_per_block, share).where("blocks * stripes > 1")
    rows = cut.limit(limits.groups + 1).collect()
    if len(rows) <= limits.groups:
        return _listed(spark, rows, True)
    return Grid(cut.select(GROUP, "blocks", "stripes", F.pmod(F.xxhash64(GROUP), F.lit(1 << 40)).alias("start")), None, True, False)


def with_group_value(df: DataFrame, name: str, values: dict[str, int] | DataFrame) -> DataFrame:
    """Add a number known per group; rows of other groups are dropped.

    A dict has been read by the driver, so its size is known and it may be
    broadcast. A DataFrame ``(grp, name)`` may be long and is joined as it is.
    """
    if isinstance(values, DataFrame):
        return df.join(values, GROUP)
    if len(values) == 1:
        (group, value), = values.items()
        return df.where(F.col(GROUP) == group).withColumn(name, F.lit(value))
    table = df.sparkSession.createDataFrame(list(values.items()), f"{GROUP} string, {name} int")
    return df.join(F.broadcast(table), GROUP)


class Kernel:
    """Work on one cell: resident rows first (turn 0), then the stream (turn 1)."""

    def __init__(self) -> None:
        self._held: list[pa.RecordBatch] = []
        self._started = False

    def take(self, turn: int, part: pa.RecordBatch) -> None:
        if turn == 0:
            self._held.append(part)
        elif self._held or self._started:
            if not self._started:
                self.start(pa.Table.from_batches(self._held))
                self._started, self._held = True, []
            self.feed(part)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self._started:
            yield from self.finish()

    def start(self, resident: pa.Table) -> None:
        raise NotImplementedError

    def feed(self, part: pa.RecordBatch) -> None:
        raise NotImplementedError

    def finish(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Kept:
    """Batches kept in a local file, to be read as often as needed."""

    def __init__(self) -> None:
        self.file, self.out = tempfile.TemporaryFile(), None

    def add(self, part: pa.RecordBatch) -> None:
        if self.out is None:
            self.out = pa.ipc.new_stream(self.file, part.schema)
        self.out.write_batch(part)

    def read(self) -> Iterator[pa.RecordBatch]:
        if self.out is not None:
            self.out.close()
            self.out = None
        self.file.seek(0)
        yield from pa.ipc.open_stream(self.file)


class Rounds(Kernel):
    """A kernel that holds ``rows`` resident rows at a time, or a quarter more, as
    blocks are even by hash only. Others wait in a file, and the stream with them."""

    def __init__(self, kernel: Callable[[], Kernel], rows: int) -> None:
        self.kernel, self.rows = kernel, max(1, rows + rows // 4)
        self.first, self.taken = kernel(), 0
        self.waiting: _Kept | None = None
        self.stream: _Kept | None = None

    def take(self, turn: int, part: pa.RecordBatch) -> None:
        if turn == 0:
            now = part.slice(0, self.rows - self.taken)
            if len(now):
                self.first.take(0, now)
                self.taken += len(now)
            if len(now) < len(part):
                self.waiting = self.waiting or _Kept()
                self.waiting.add(part.slice(len(now)))
            return
        self.first.take(turn, part)
        if self.waiting:
            self.stream = self.stream or _Kept()
            self.stream.add(part)

    def result(self) -> Iterator[pa.RecordBatch]:
        yield from self.first.result()
        self.first = None
        if self.stream is None:
            return
        work, taken = self.kernel(), 0
        for part in self.waiting.read():
            while len(part):
                now = part.slice(0, self.rows - taken)
                part = part.slice(len(now))
                work.take(0, now)
                taken += len(now)
                if taken == self.rows:
                    yield from self._finish(work)
                    work, taken = self.kernel(), 0
        if taken:
            yield from self._finish(work)

    def _finish(self, work: Kernel) -> Iterator[pa.RecordBatch]:
        for part in self.stream.read():
            work.take(1, part)
        yield from work.result()


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Consecutive rows with equal values in the named columns, of sorted rows."""
    if batch.num_rows == 0:
        return
    codes = np.stack(
        [pc.dictionary_encode(batch.column(n)).indices.to_numpy() for n in names]
    )
    starts = np.flatnonzero(np.any(np.diff(codes, axis=1) != 0, axis=0)) + 1
    bounds = [0, *starts.tolist(), batch.num_rows]
    for lo, hi in zip(bounds, bounds[1:]):
        yield tuple(batch.column(n)[lo].as_py() for n in names), batch.slice(lo, hi - lo)


def groups_of(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each group, in whatever order they come."""
    coded = pc.dictionary_encode(batch.column(GROUP))
    if len(coded.dictionary) == 1:
        yield coded.dictionary[0].as_py(), batch
        return
    codes = coded.indices.to_numpy()
    for code, group in enumerate(coded.dictionary.to_pylist()):
        yield group, batch.take(pa.array(np.flatnonzero(codes == code)))


def shuffle_tasks(df: DataFrame) -> int:
    """Shuffle partitions, or cores if they are fewer: each cell that has no core
    to itself only repeats rows. A session may not know all its cores yet."""
    spark = df.sparkSession
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, spark.sparkContext.defaultParallelism))


def run_cells(
    rows: DataFrame, n_cells: int | None, kernel: Callable[[], Kernel], schema: str, numbered: bool = False
) -> DataFrame:
    """Bring each cell of a group into one task, in turn order; run the kernel.

    Nothing is gathered: rows arrive in Arrow batches from a sorted partition
    and only the kernel's bounded state stays in memory. Neighbouring cells go
    to different tasks, a few cells to each, so that tasks even out; each group
    begins at a task by its hash, unless cells are ``numbered`` across groups.
    """
    parts = TASKS_PER_CORE * shuffle_tasks(rows)
    if n_cells is not None:
        parts = max(1, min(parts, n_cells))
    n = F.lit(parts)
    first = F.lit(0) if numbered else F.pmod(F.xxhash64(GROUP), n)
    place = F.pmod(first + F.col("cell"), n).cast("int")
    keys = [GROUP, "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, work = None, None
        for batch in batches:
            for (*key, turn), part in _runs(batch, [*keys, "turn"]):
                if key != cell:
                    if work is not None:
                        yield from work.result()
                    cell, work = key, kernel()
                work.take(turn, part)
        if work is not None:
            yield from work.result()

    return (
        rows.repartitionById(parts, place)
        .sortWithinPartitions(*keys, "turn")
        .mapInArrow(run, schema)
    )


def _broadcast_sweep(
    resident: DataFrame, stream: DataFrame, kernel: Callable[[], Kernel], schema: str
) -> DataFrame:
    held = resident.sparkSession.sparkContext.broadcast(resident.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work: dict[str, Kernel] = {}
        for batch in batches:
            for group, part in groups_of(batch):
                if group not in work:
                    mine = held.value.filter(pc.equal(held.value[GROUP], group))
                    work[group] = kernel()
                    for rows in mine.to_batches():
                        work[group].take(0, rows)
                work[group].take(1, part)
        for each in work.values():
            yield from each.result()

    # Splits are read several to a task: each task returns a result per query.
    return stream.coalesce(TASKS_PER_CORE * shuffle_tasks(stream)).mapInArrow(run, schema)


def bucket(n: Column) -> Column:
    """One of n parts, by a hash of the id."""
    return F.pmod(F.xxhash64("id"), n).cast("int")


def every(n: Column) -> Column:
    """All of n parts: the row is repeated for each."""
    return F.explode(F.sequence(F.lit(0), n - 1))


def _in_grid(rows: DataFrame, grid: Grid) -> DataFrame:
    """Rows with their group's grid; rows without anything to compare go."""
    if grid.only:
        group, blocks, stripes, start = grid.only
        return rows.where(F.col(GROUP) == group).withColumns({"blocks": F.lit(blocks), "stripes": F.lit(stripes), "start": F.lit(start).cast("long")})
    table = F.broadcast(grid.groups) if grid.small else grid.groups
    if not grid.others:
        return rows.join(table, GROUP)
    rows = rows.join(table, GROUP, "left")
    own = F.pmod(F.xxhash64(GROUP), F.lit(1 << 40))
    return rows.withColumns({
        "blocks": F.coalesce("blocks", F.lit(1)), "stripes": F.coalesce("stripes", F.lit(1)), "start": F.coalesce("start", own),
    })


def cells_of(resident: DataFrame, stream: DataFrame, grid: Grid) -> DataFrame:
    """All rows at the cells they belong to, with ``cell`` and ``turn``: a resident
    row in one block of every stripe, a passing row in one stripe of every block."""
    block, stripe = bucket(F.col("blocks")), bucket(F.col("stripes"))
    held = _in_grid(resident, grid).select(
        *resident.columns, "start", "stripes", block.alias("block"), every(F.col("stripes")).alias("stripe"), F.lit(0).alias("turn")
    )
    passing = _in_grid(stream, grid).select(
        *stream.columns, "start", "stripes", stripe.alias("stripe"), every(F.col("blocks")).alias("block"), F.lit(1).alias("turn")
    )
    rows = held.unionByName(passing, allowMissingColumns=True)
    return rows.withColumn("cell", F.col("start") + F.col("block") * F.col("stripes") + F.col("stripe")).drop("start", "stripes", "block", "stripe")


def sweep(
    resident: DataFrame,
    stream: DataFrame,
    kernel: Callable[[], Kernel],
    schema: str,
    fit: Fit,
    grid: Grid | None = None,
) -> DataFrame:
    """Partial results of every resident row against every row of its group.

    ``grid`` may be that of larger sides, to count them only once.
    """
    if fit.empty:
        return resident.sparkSession.createDataFrame([], schema)
    if fit.broadcast:
        return _broadcast_sweep(resident, stream, kernel, schema)
    grid = grid or lay_out(resident, stream, fit)
    if grid.cells == 0:
        return resident.sparkSession.createDataFrame([], schema)
    rounds = partial(Rounds, kernel, fit.rows_per_block)
    return run_cells(cells_of(resident, stream, grid), grid.cells, rounds, schema, numbered=True)
