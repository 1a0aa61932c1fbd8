"""Embedding by a remote service: few calls at a time, and none asked twice.

Rows are cut into chunks of one call each and written to a *ledger*, a folder
that all executors share. A wave answers ``max_parallel`` chunks, one in each
task, and its answers become part of the ledger. So no more calls are in flight
than the service allows, whatever the partitions of the rows; a task that is
lost repeats its one chunk; and a run that was stopped goes on with the waves
that have no answers yet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternrank.functions.text import MAX_TOKENS, truncate_tokens
from lanternrank.operators.embed import (
    ATTEMPTS,
    CHUNK,
    MAX_PARALLEL,
    WAIT_CONNECTION,
    WAIT_OTHER,
    Encoder,
    checked,
    embed,
    float_lists,
)
from lanternrank.sources.records import fresh_path

_AT, _CHUNK, _WAVE, _TEXT = "_at", "_chunk", "_wave", "_text"
_LOW = (1 << 33) - 1  # of a row's number, its place in its partition


@dataclass(frozen=True)
class RemoteEncoder:
    """An embedding service, chosen by its exact name.

    ``client`` is a factory, called once per task; what it returns takes a list
    of texts and an endpoint and gives one vector per text. Texts are cut to
    ``max_tokens`` tokens of ``codec`` (words, if there is none) before they are
    sent. ``dimension`` is the length of vectors; if it is not given, it is the one
    that most vectors of the first wave with any have.
    """

    name: str
    client: Callable[[], Callable[[list[str], str], Sequence]]
    endpoints: tuple[str, ...] = ("",)
    prompt: Callable[[Column], Column] | None = None
    max_tokens: int | None = MAX_TOKENS
    codec: Callable[[], tuple[Callable, Callable]] | None = None
    dimension: int | None = None
    chunk: int = CHUNK
    max_parallel: int = MAX_PARALLEL
    attempts: int = ATTEMPTS
    wait_connection: float = WAIT_CONNECTION
    wait_other: float = WAIT_OTHER

    def ask(self, send: Callable, texts: list[str], endpoint: str) -> list[tuple]:
        """One call, repeated while it fails; ``(vector, error)`` of each text."""
        error = "empty response"
        for attempt in range(self.attempts):
            wait = 0.0
            try:
                response = send(texts, endpoint)
                if response is not None:
                    return checked(response, len(texts), self.dimension)
                error = "empty response"
            except ConnectionError as e:
                error, wait = f"connection: {e}", self.wait_connection
            except Exception as e:  # noqa: BLE001 - any failure is retried
                error, wait = f"{type(e).__name__}: {e}", self.wait_other
            if attempt + 1 < self.attempts:
                time.sleep(wait)
        return [(None, error)] * len(texts)


def as_remote(model: Encoder, role: str = "passage", **options) -> RemoteEncoder:
    """A local encoder under a ledger, for models whose answers are costly."""
    load = model.load

    def client() -> Callable[[list[str], str], list[list[float]]]:
        run = load()
        return lambda texts, endpoint: run(texts, role).tolist()

    return RemoteEncoder(model.name, client, prompt=model.prompt, max_tokens=None, **options)


class Ledger:
    """Chunks to ask and answers so far, below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.chunks, self.answers = f"{self.path}/chunks", f"{self.path}/answers"

    def _names(self, folder: str) -> set[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {f.getPath().getName() for f in files.listStatus(place)} if files.exists(place) else set()

    def complete(self, folder: str) -> bool:
        return "_SUCCESS" in self._names(folder)

    def wave(self, folder: str, n: int) -> str:
        return f"{folder}/{_WAVE}={n}"

    def waves(self) -> list[int]:
        """Numbers of the waves, of all chunks."""
        return sorted(int(x.partition("=")[2]) for x in self._names(self.chunks) if x.startswith(_WAVE))

    def lay_down(self, rows: DataFrame, size: int, per_wave: int) -> None:
        """Writes the rows with the chunk and the wave that each belongs to.

        Rows are numbered by their place in their partition after the sizes of
        the partitions before; only those sizes are read here.
        """
        if self.complete(self.chunks):
            return
        rows.withColumn(_AT, F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/rows")
        kept = self.spark.read.parquet(f"{self.path}/rows")
        part = F.shiftright(_AT, 33)
        sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
        starts, total = [], 0
        for row in sorted(sizes, key=lambda r: r.part):
            starts.append((row.part, total))
            total += row.n
        table = F.broadcast(self.spark.createDataFrame(starts, "_part long, _start long"))
        number = F.col("_start") + F.col(_AT).bitwiseAND(F.lit(_LOW))
        kept = kept.withColumn("_part", part).join(table, "_part").withColumn(_CHUNK, F.floor(number / size).cast("long"))
        kept = kept.withColumn(_WAVE, F.floor(F.col(_CHUNK) / per_wave).cast("long")).drop("_part", "_start")
        kept.write.mode("overwrite").partitionBy(_WAVE).parquet(self.chunks)


def _answered(rows: DataFrame, model: RemoteEncoder) -> DataFrame:
    """One wave: every chunk in a task of its own, asked in one call."""
    spots, size = list(model.endpoints), model.chunk

    def request(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        send = model.client()
        for texts, chunks in batches:
            values, numbers = texts.to_pylist(), chunks.to_pylist()
            out: list[tuple] = [(None, None)] * len(values)
            real = [i for i, text in enumerate(values) if text is not None]
            for lo in range(0, len(real), size):
                some = real[lo : lo + size]
                spot = spots[numbers[some[0]] % len(spots)]
                for i, answer in zip(some, model.ask(send, [values[i] for i in some], spot)):
                    out[i] = answer
            yield pa.StructArray.from_arrays(
                [float_lists([v for v, _ in out]), pa.array([e for _, e in out], pa.string())], ["embedding", "error"]
            )

    ask = F.arrow_udf(request, "embedding array<float>, error string").asNondeterministic()
    n = F.lit(model.max_parallel)
    placed = rows.repartitionById(model.max_parallel, F.pmod(F.col(_CHUNK), n).cast("int")).sortWithinPartitions(_CHUNK, _AT)
    return placed.withColumn("_answer", ask(F.col(_TEXT), F.col(_CHUNK)))


def embed_by_ledger(
    df: DataFrame, text_col: str, model: RemoteEncoder, role: str = "passage", out: str = "embedding", ledger: str | None = None
) -> DataFrame:
    """``df`` with the embedding of a text column and an ``error``, as a table.

    NULL text has a NULL embedding and no error; rows of a call that failed to
    the last attempt have a NULL embedding and the error, as have vectors of
    another length. Give ``ledger``, a folder that all executors share, to be
    able to go on after a run was stopped: then nothing that it has an answer
    for is asked again, and its rows are used as they were. Columns of ``df``
    named ``error`` or as ``out`` are replaced.
    """
    if role not in ("passage", "query"):
        raise ValueError(f"role must be passage or query, not {role!r}")
    spark = df.sparkSession
    text = F.col(text_col)
    if role == "query" and model.prompt is not None:
        text = model.prompt(text)
    if model.max_tokens is not None:
        text = truncate_tokens(text, model.max_tokens, model.codec)
    kept = [c for c in df.columns if c not in (out, "error")]
    book = Ledger(spark, ledger or fresh_path(spark, "ledger"))
    book.lay_down(df.select(*kept, text.alias(_TEXT)), model.chunk, model.max_parallel)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])
    for n in book.waves():
        target = book.wave(book.answers, n)
        if book.complete(target):
            if model.dimension is None:
                model = replace(model, dimension=_dimension(spark.read.schema(schema).parquet(target), out))
            continue
        rows = _answered(spark.read.parquet(book.wave(book.chunks, n)), model)
        done = rows.select(*kept, F.col("_answer.embedding").alias(out), F.col("_answer.error").alias("error"))
        done.write.mode("overwrite").parquet(target)
        if model.dimension is None:
            model = replace(model, dimension=_dimension(spark.read.schema(schema).parquet(target), out))
    if not book.waves():
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(book.answers)
    if model.dimension is None:
        return found
    # Chunks of the first wave may have disagreed before the length was known.
    right = F.size(out) == model.dimension
    said = F.concat(F.size(out).cast("string"), F.lit(f" components, not {model.dimension}"))
    return found.withColumns({out: F.when(right, F.col(out)), "error": F.when(F.col(out).isNull() | right, F.col("error")).otherwise(said)})


def _dimension(rows: DataFrame, out: str) -> int | None:
    """The length that most vectors of a wave have; of equally many, the larger."""
    sizes = rows.where(F.col(out).isNotNull()).groupBy(F.size(out).alias("n")).agg(F.count("*").alias("times"))
    first = sizes.orderBy(F.desc("times"), F.desc("n")).limit(1).collect()
    return first[0].n if first else None


def encode(
    df: DataFrame, text_col: str, model: Encoder | RemoteEncoder, role: str = "passage", out: str = "embedding", ledger: str | None = None
) -> DataFrame:
    """Embeddings by a local model or a remote service, as the encoder is."""
    if isinstance(model, RemoteEncoder):
        return embed_by_ledger(df, text_col, model, role, out, ledger)
    return embed(df, text_col, model, role, out)
