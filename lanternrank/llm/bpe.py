"""Byte-level BPE with a public rank file, run by sentencepiece.

The rank file maps byte strings to ranks. A sentencepiece BPE model with the
same merges is written down directly: every token becomes a piece, its bytes
mapped to one character each and its score the negative rank, with identity
normalisation. Text is cut into pre-tokens by the public pattern, each distinct
pre-token is encoded once per worker, and decoding joins the bytes of the ids.
"""

import base64
import collections.abc
import re
import struct
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternrank.llm.shared import over_slices

# Distinct pre-tokens that a worker remembers before it starts anew, and the
# longest that it remembers.
REMEMBERED = 200_000
LONGEST = 64
# Characters of texts that are cut at once, one text at least: their pre-tokens
# take many times the memory of the texts.
TOGETHER = 1 << 17

# Letters and digits of Unicode 16 that the Python version's own
# tables may lack, as first and last code points.
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3),
    (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
LATER_DIGITS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139),
    (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
# Fixed value: the white space of Unicode.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(kind: str, later: tuple[tuple[int, int], ...]) -> str:
    """A category as a character class of the standard ``re`` module."""
    marks = np.zeros(0x110000, bool)
    for c in range(0x110000):
        marks[c] = unicodedata.category(chr(c))[0] == kind
    for first, last in later:
        marks[first : last + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))


def plain_pattern(pattern: str) -> str:
    r"""The public pattern with \p{L}, \p{N} and \s spelled out.

    The standard ``re`` module then runs it, twice as fast as a module that
    knows such classes, and with one Unicode version on every worker.
    """
    letters, digits = _class("L", LATER_LETTERS), _class("N", LATER_DIGITS)
    inside = {r"\p{L}": letters, r"\p{N}": digits, r"\s": SPACES}

    def bracket(m: re.Match) -> str:
        return re.sub(r"\\p\{[LN]\}|\\s", lambda k: inside[k[0]], m[0])

    out = []
    for part in re.split(r"(\[[^\]]*\])", pattern):
        if part.startswith("["):
            out.append(re.sub(r".+", bracket, part))
        else:
            part = re.sub(r"\\p\{[LN]\}|\\s", lambda k: f"[{inside[k[0]]}]", part)
            out.append(part.replace(r"\S", f"[^{SPACES}]"))
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a serialised message: varint, 32-bit float or bytes."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


# Bytes as characters: none is white space or has a meaning to the library.
AS_CHARACTERS = {b: chr(0x100 + b) for b in range(256)}


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(AS_CHARACTERS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary; piece 0 is the unknown, then by rank."""
    # Field numbers and codes of the public model format.
    piece, trainer, normalizer = 1, 2, 3
    normal, unknown, bpe = 1, 2, 2
    out = [_field(piece, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = mapped(token).encode()
        out.append(_field(piece, _field(1, text) + _field(2, float(-rank)) + _field(3, normal)))
    out.append(_field(trainer, _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, 0)))
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    out.append(_field(normalizer, plain))
    return b"".join(out)


class Vocabulary:
    """What tasks need of a rank file: model, ids, bytes of ids, pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = model_bytes(ranks)
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.ids = sorted(ranks.values())
        self.pattern = plain_pattern(pattern)
        self.coder = None

    def encoder(self) -> "Encoder":
        """The encoder of this process; a worker keeps it from task to task."""
        if self.coder is None:
            self.coder = Encoder(self)
        return self.coder


class Encoder:
    """Text to ids in one worker."""

    def __init__(self, vocabulary: Vocabulary):
        import sentencepiece

        self.find = re.compile(vocabulary.pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.ids = np.array([-1, *vocabulary.ids], np.int32)
        # A pre-token that is a token is that token, whatever merges would give.
        self.whole = {mapped(t): i for t, i in zip(vocabulary.tokens, vocabulary.ids, strict=True)}
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        texts = [mapped(w.encode()) for w in words]
        rest = [x for x in texts if x not in self.whole]
        cut = iter(self.pieces.encode(rest, num_threads=1)) if rest else iter(())
        return {
            w: (
                np.int32(self.whole[x]) if x in self.whole else self.ids[next(cut)]
            ).tobytes()
            for w, x in zip(words, texts, strict=True)
        }

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as bytes of 32-bit integers."""
        out: list[bytes] = []
        start = size = 0
        for k, text in enumerate(texts):
            if size and size + len(text) > TOGETHER:
                out += self._encode(texts[start:k])
                start, size = k, 0
            size += len(text)
        return out + self._encode(texts[start:])

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = self._learn([w for w in set(chain.from_iterable(cut)) if w not in self.known])
        long = {w: new.pop(w) for w in [w for w in new if len(w) > LONGEST]}
        self.known.update(new)
        if long:
            every = {**self.known, **long}
            return [b"".join(map(every.__getitem__, words)) for words in cut]
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """The vocabulary of a rank file, read here and sent to the workers once.

    A vocabulary is a fixed file of some 50,000 tokens, about one megabyte.
    """
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path), pattern))


def encode(docs: DataFrame, words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: the token ids (array<int>) of every whole text, in order.

    ``words`` comes from ``vocabulary``. NULL and empty texts have no ids; rows
    may repeat and ids may be NULL, each row is encoded for itself; other
    columns are left out, so their names cannot clash. Texts are taken in
    slices of bounded size, a very long text alone.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = words.value.encoder()([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(parts)], [id_col, "ids"])

    kept = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = kept.schema[id_col].dataType.simpleString()
    return over_slices(kept, "text", work, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, words, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in the binary column ``out``.

    Ids outside the vocabulary are an error; NULL ids give no bytes. Any other
    columns stay, but a column named as ``out`` is replaced.
    """

    def work(batches: collections.abc.Iterator[pa.Array]) -> collections.abc.Iterator[pa.Array]:
        token = dict(zip(words.value.ids, words.value.tokens, strict=True)).__getitem__
        for ids in batches:
            flat = ids.flatten().to_numpy()
            sizes = np.where(ids.is_null(), 0, np.diff(ids.offsets.to_numpy()))
            ends = np.cumsum(np.r_[0, sizes])
            yield pa.array(
                [b"".join(map(token, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)],
                pa.binary(),
            )

    return encoded.withColumn(out, F.arrow_udf("binary")(work)(ids_col))


def encode_checked(docs: DataFrame, words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids, round_trip`` of every row: its ids, and whether they
    decode to its whole text. NULL and empty texts have no ids and come back."""
    coder = words

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = coder.value
        token = dict(zip(vocabulary.ids, vocabulary.tokens, strict=True)).__getitem__
        texts = [t or "" for t in batch.column(1).to_pylist()]
        parts = vocabulary.encoder()(texts)
        same = [
            b"".join(map(token, np.frombuffer(p, np.int32).tolist())) == t.encode()
            for p, t in zip(parts, texts, strict=True)
        ]
        sizes = pa.array([len(p) // 4 for p in parts], pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), sizes, _lists(parts), pa.array(same, pa.bool_())], [id_col, "n_tokens", "ids", "round_trip"]
        )

    kept = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = kept.schema[id_col].dataType.simpleString()
    return over_slices(kept, "text", work, f"`{id_col}` {kind}, n_tokens long, ids array<int>, round_trip boolean")


def joined(ids: str) -> Column:
    """Ids as decimal numbers with one space between."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
