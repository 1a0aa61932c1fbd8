"""Text to vectors in Arrow batches, with a local or a remote encoder."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternrank.functions.text import instruct, truncate_tokens

if TYPE_CHECKING:
    from lanternrank.operators.remote import RemoteEncoder

# How a remote service is called.
CHUNK = 256
MAX_PARALLEL = 15
ATTEMPTS = 5
WAIT_CONNECTION = 7.0
WAIT_OTHER = 10.0


@dataclass(frozen=True)
class Encoder:
    """An embedding model.

    ``load`` runs once per Python worker and returns a function from a list of
    texts and a role (``query`` or ``passage``) to a float matrix, one row per
    text. ``prompt`` rewrites queries before they are encoded. ``max_tokens``
    cuts texts by role, in tokens of ``codec`` (words, if there is none).
    """

    name: str
    load: Callable[[], Callable[[list[str], str], np.ndarray]]
    prompt: Callable[[Column], Column] | None = None
    batch_size: int = 256
    max_tokens: Mapping[str, int] | None = None
    codec: Callable[[], tuple[Callable, Callable]] | None = None


_REGISTRY: dict[str, Encoder | RemoteEncoder] = {}
_LOADED: dict[str, Callable] = {}  # per Python worker


def register_encoder(encoder: Encoder | RemoteEncoder) -> Encoder | RemoteEncoder:
    """Make an encoder known: local models by the prefix of a model's base name,
    remote services by their exact name."""
    _REGISTRY[encoder.name] = encoder
    return encoder


def encoder(model: str) -> Encoder | RemoteEncoder:
    """The remote service of that name, else the local encoder whose name begins
    the model's base name; of several, the longest."""
    if model in _REGISTRY and not isinstance(_REGISTRY[model], Encoder):
        return _REGISTRY[model]
    base = model.rstrip("/").rsplit("/", 1)[-1]
    fitting = [n for n, e in _REGISTRY.items() if base.startswith(n) and isinstance(e, Encoder)]
    if not fitting:
        raise ValueError(f"no encoder is registered for {model!r}")
    return _REGISTRY[max(fitting, key=len)]


def instructed(name: str, load: Callable, batch_size: int = 256) -> Encoder:
    """An encoder whose queries carry the search instruction."""
    return Encoder(name, load, instruct, batch_size)


def _loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of this worker; found by module name, so tasks share it."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def float_lists(rows: list[np.ndarray | None]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float32()))


def embed(
    df: DataFrame, text_col: str, model: Encoder, role: str = "passage", out: str = "embedding"
) -> DataFrame:
    """Add the embedding of a text column; NULL text has a NULL embedding.

    Only the text crosses to Python. Within an Arrow batch texts go to the
    model in lists of ``batch_size``.
    """
    if role not in ("passage", "query"):
        raise ValueError(f"role must be passage or query, not {role!r}")
    name, load, size = model.name, model.load, model.batch_size

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = _loaded(name, load)
        for batch in batches:
            texts = batch.to_pylist()
            real = [i for i, text in enumerate(texts) if text is not None]
            rows: list[np.ndarray | None] = [None] * len(texts)
            for lo in range(0, len(real), size):
                chosen = real[lo : lo + size]
                vectors = np.asarray(run([texts[i] for i in chosen], role), dtype=np.float32)
                for i, vector in zip(chosen, vectors):
                    rows[i] = vector
            yield float_lists(rows)

    # Declared nondeterministic so that a model never runs twice on a row,
    # e.g. because a filter on its result was moved below it.
    run_model = F.arrow_udf(encode, "array<float>").asNondeterministic()
    text = F.col(text_col)
    if role == "query" and model.prompt is not None:
        text = model.prompt(text)
    if model.max_tokens is not None:
        text = truncate_tokens(text, model.max_tokens[role], model.codec)
    return df.withColumn(out, run_model(text))


def checked(
    response: object, n: int, dimension: int | None = None
) -> list[tuple[list[float] | None, str | None]]:
    """Keep well-formed vectors of a response; say what is wrong with others.

    Without a declared dimension the first good vector of the response sets it.
    """
    vectors = list(response)  # type: ignore[call-overload]
    if len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    checked = []
    for vector in vectors:
        good = isinstance(vector, list) and len(vector) > 0 and isinstance(vector[0], float)
        if good and dimension is None:
            dimension = len(vector)
        if good and len(vector) != dimension:
            checked.append((None, f"{len(vector)} components, not {dimension}"))
        else:
            checked.append((vector, None) if good else (None, "not a list of floats"))
    return checked


def embed_remote(
    df: DataFrame,
    text_col: str,
    client: Callable[[], Callable[[list[str], str], Sequence]],
    endpoints: Sequence[str] = ("",),
    chunk: int = CHUNK,
    max_parallel: int | None = MAX_PARALLEL,
    attempts: int = ATTEMPTS,
    wait_connection: float = WAIT_CONNECTION,
    wait_other: float = WAIT_OTHER,
    out: str = "embedding",
    dimension: int | None = None,
) -> DataFrame:
    """Add ``embedding`` and ``error`` from a remote service.

    ``client`` is a factory, called once per task; what it returns takes a list
    of texts and an endpoint and gives one vector per text. Calls carry
    ``chunk`` texts and go round the endpoints. A call that fails is repeated;
    after the last attempt its rows have a NULL embedding and an error.

    A vector that has not ``dimension`` components becomes NULL with an error.

    ``max_parallel`` partitions mean at most that many calls at a time, which
    is what services limit; pass None to keep the partitions of ``df``. This
    form is lazy, e.g. for streams, and a task that is lost asks for its whole
    partition again; for large tables see ``remote.embed_by_ledger``.
    """
    spots = list(endpoints)

    def call(send: Callable, texts: list[str], endpoint: str) -> list[tuple]:
        error = "empty response"
        for attempt in range(attempts):
            wait = 0.0
            try:
                response = send(texts, endpoint)
                if response is not None:
                    return checked(response, len(texts), dimension)
                error = "empty response"
            except ConnectionError as e:
                error, wait = f"connection: {e}", wait_connection
            except Exception as e:  # noqa: BLE001 - any failure is retried
                error, wait = f"{type(e).__name__}: {e}", wait_other
            if attempt + 1 < attempts:
                time.sleep(wait)
        return [(None, error)] * len(texts)

    def request(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        send = client()
        calls = TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.to_pylist()
            real = [i for i, text in enumerate(texts) if text is not None]
            rows: list[tuple] = [(None, None)] * len(texts)
            for lo in range(0, len(real), chunk):
                chosen = real[lo : lo + chunk]
                answers = call(send, [texts[i] for i in chosen], spots[calls % len(spots)])
                calls += 1
                for i, answer in zip(chosen, answers):
                    rows[i] = answer
            yield pa.StructArray.from_arrays(
                [float_lists([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())],
                ["embedding", "error"],
            )

    ask = F.arrow_udf(request, "embedding array<float>, error string").asNondeterministic()
    if max_parallel is not None:
        df = df.repartition(max_parallel)
    answered = df.withColumn("_answer", ask(F.col(text_col)))
    return answered.select(
        *df.columns, F.col("_answer.embedding").alias(out), F.col("_answer.error").alias("error")
    )
