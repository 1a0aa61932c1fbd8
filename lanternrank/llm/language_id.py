"""Language identification by unigram pieces, summed over all segmentations.

Each language gives a probability to every piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces,
computed by the forward algorithm; a text is scored by the product over its
words. The piece probabilities come from expectation maximisation over the same
sum, on a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternrank.llm.shared import held_out, over_slices

# Labelled texts that a language is learned from, those of the smallest hash.
PER_LANGUAGE = 400
ROUNDS = 4
# Probability of a single character outside the vocabulary, for all languages.
UNKNOWN = 1e-7
# Added to every expected count, so that no piece is impossible.
FLOOR = 0.05
# Words up to this length are scored without rescaling.
LONGEST = 48
# Characters of longer words that are scored together, padding included.
LONG_CHARS = 1 << 15
# Keeps products of small probabilities in range, a factor per character.
PER_CHAR = 16.0
REMEMBERED = 300_000

WORDS = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
START = "▁"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; numerals such as ½ or Ⅷ are none."""
    found = WORDS.findall(text.lower()) if text else []
    # The quick pattern also takes numerals that are no digits.
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else LETTERS.findall(run))]


class Pieces:
    """A vocabulary of strings that finds the pieces of many words at once.

    Prefixes of words are hashed by a polynomial, so that the hash of any part
    is a difference of two; an open hash table maps it to the piece.
    """

    BASE, MIX, BITS, WORD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 18, (1 << 64) - 1

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.lengths = np.array([len(p) for p in pieces])
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.ids = np.full(1 << self.BITS, -1, np.int32)
        for k, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * self.BASE + ord(c) + 1) & self.WORD
            at = ((h ^ (h >> 29)) * self.MIX & self.WORD) >> (64 - self.BITS)
            while self.ids[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.keys[at], self.ids[at] = h, k

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; the number of pieces where there is none."""
        at = (((h ^ (h >> np.uint64(29))) * np.uint64(self.MIX)) >> np.uint64(64 - self.BITS)).astype(np.int32)
        found = self.ids[at]
        other = np.flatnonzero((found >= 0) & (self.keys[at] != h))
        while other.size:
            at[other] = (at[other] + 1) & ((1 << self.BITS) - 1)
            found[other] = self.ids[at[other]]
            other = other[(found[other] >= 0) & (self.keys[at[other]] != h[other])]
        found[found < 0] = len(self.pieces)
        return found

    def parts(self, chars: np.ndarray) -> np.ndarray:
        """``[stop, back, row]``: the piece of the ``back + 1`` characters before ``stop``."""
        rows, width = chars.shape
        prefix = np.zeros((width + 1, rows), np.uint64)
        for k in range(width):
            prefix[k + 1] = prefix[k] * np.uint64(self.BASE) + chars[:, k] + np.uint64(1)
        reach = min(self.longest, width)
        out = np.full((width + 1, reach, rows), len(self.pieces), np.int32)
        power = 1
        for back in range(1, reach + 1):
            power = power * self.BASE & self.WORD
            h = prefix[back:] - prefix[: width + 1 - back] * np.uint64(power)
            out[back:, back - 1] = self._find(h.ravel()).reshape(h.shape)
        return out


def read_pieces(path: str) -> list[str]:
    """The text pieces of a sentencepiece model, in lower case, without repeats."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = dict.fromkeys(
        model.id_to_piece(i).lower()
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    )
    return [p for p in kept if p]


def _groups(words: list[str], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: their places and their code points."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        for k in range(0, len(same), most):
            rows = same[k : k + most]
            text = START + START.join(words[r] for r in rows)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
            yield rows, points.reshape(len(rows), n + 1)


def _scaled(pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Probabilities with a factor per character, and 0 for what is no piece."""
    return np.vstack([PER_CHAR ** pieces.lengths[:, None] * table, np.zeros(table.shape[1])])


def _forward(parts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: ``[stop, row, language]``."""
    width, reach, rows = parts.shape[0] - 1, parts.shape[1], parts.shape[2]
    sums = np.ones((width + 1, rows, scale.shape[1]))
    for stop in range(1, width + 1):
        back = min(reach, stop)
        before = sums[stop - back : stop][::-1]
        sums[stop] = (before * scale[parts[stop, :back]]).sum(0) + sums[stop - 1] * (UNKNOWN * PER_CHAR)
    return sums


def log_likelihoods(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word under each language, over all segmentations.

    ``table`` holds piece probabilities, one column per language.
    """
    out = np.zeros((len(words), table.shape[1]))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(lengths <= LONGEST)
    scale = _scaled(pieces, table)
    for rows, chars in _groups([words[k] for k in short]):
        whole = _forward(pieces.parts(chars), scale)[-1]
        out[short[rows]] = np.log(whole) - chars.shape[1] * np.log(PER_CHAR)
    long = np.flatnonzero(lengths > LONGEST)
    long = long[np.argsort(lengths[long], kind="stable")]
    while len(long):
        # As many as fit, padded to the longest; one at least.
        fit = np.arange(1, len(long) + 1) * lengths[long] <= LONG_CHARS
        n = max(1, int(np.searchsorted(~fit, True)))
        out[long[:n]] = _long(pieces, table, [words[k] for k in long[:n]])
        long = long[n:]
    return out


def _long(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """The same sums for words of any length, rescaled at each step."""
    lengths = np.array([len(w) + 1 for w in words])
    chars = np.zeros((len(words), lengths.max()), np.uint64)
    for row, w in zip(chars, words):
        row[: len(w) + 1] = np.frombuffer((START + w).encode("utf-32-le"), np.uint32)
    parts = pieces.parts(chars)
    scale = np.vstack([table, np.zeros(table.shape[1])])
    reach = parts.shape[1]
    recent = np.zeros((reach, len(words), table.shape[1]))  # the latest first
    recent[0] = 1.0
    logs = np.zeros((len(words), table.shape[1]))
    for stop in range(1, len(parts)):
        total = (recent * scale[parts[stop]]).sum(0) + recent[0] * UNKNOWN
        logs += np.where(stop <= lengths[:, None], np.log(total), 0.0)
        recent[1:] = recent[:-1] / total
        recent[0] = 1.0
    return logs


def learn(pieces: Pieces, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Piece probabilities of one language: rounds of expected counts over all segmentations."""
    # Longer words are learned from in parts.
    cut = [[w[k : k + LONGEST] for k in range(0, len(w), LONGEST)] for w in words]
    counts = np.repeat(counts.astype(float), list(map(len, cut)))
    words = [part for parts in cut for part in parts]
    groups = [(counts[rows], pieces.parts(chars)) for rows, chars in _groups(words)]
    p = np.full(len(pieces.pieces), 1.0 / len(pieces.pieces))
    for _ in range(ROUNDS):
        expected = np.zeros(len(p) + 1)
        scale = _scaled(pieces, p[:, None])
        flat = scale[:, 0]
        for weight, parts in groups:
            width, reach = parts.shape[0] - 1, parts.shape[1]
            forward = _forward(parts, scale)[:, :, 0]
            backward = np.zeros_like(forward)
            backward[width] = weight / forward[width]
            for stop in range(width, 0, -1):
                back = min(reach, stop)
                found = parts[stop, :back]
                used = flat[found] * backward[stop]
                backward[stop - back : stop] += used[::-1]
                backward[stop - 1] += backward[stop] * (UNKNOWN * PER_CHAR)
                used *= forward[stop - back : stop][::-1]
                expected += np.bincount(found.ravel(), used.ravel(), len(expected))
        p = (expected[:-1] + FLOOR) / (expected[:-1].sum() + FLOOR * len(p))
    return p


class Model:
    """Languages, vocabulary and piece probabilities."""

    def __init__(self, languages: list[str], pieces: list[str], table: np.ndarray):
        self.languages, self.names, self.table = languages, pieces, table
        self.worker = None

    def scorer(self) -> Scorer:
        if self.worker is None:
            self.worker = Scorer(self)
        return self.worker


class Scorer:
    """Texts to log likelihoods in one worker, each distinct word computed once."""

    def __init__(self, model: Model):
        self.pieces, self.table = Pieces(model.names), model.table
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.known = np.zeros((1 << 12, self.table.shape[1]))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood per language, and the number of words."""
        cut = [words_of(t) for t in texts]
        if len(self.places) > REMEMBERED:
            self.forget()
        new = [w for w in set(chain.from_iterable(cut)) if w not in self.places]
        if new:
            scores = log_likelihoods(self.pieces, self.table, new)
            first = len(self.places)
            while len(self.known) < first + len(new):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[first : first + len(new)] = scores
            self.places.update(zip(new, range(first, first + len(new)), strict=True))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(cut)), np.int64, sizes.sum())
        sums = np.zeros((len(cut), self.table.shape[1]))
        some = np.flatnonzero(sizes)
        if some.size:
            starts = (np.cumsum(sizes) - sizes)[some]
            sums[some] = np.add.reduceat(self.known[at], starts)
        return sums, sizes


def train(
    docs: DataFrame,
    pieces: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model:
    """A model of every language named in ``lang_col``.

    Learns only from rows with a text and a language whose crc32(id) mod 4 is
    not 2, at most ``per_language`` of each language, those whose id has the
    smallest hash (ties by id, then any). Spark gathers the word counts of each
    language's sample and one task per language learns from them. Without such
    rows the model has no languages.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    ).where("lang is not null and text is not null and id is not null").where(~held_out("id"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (
        rows.select("lang", "id").withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_language).select("id", "lang")
    )
    # The sample has at most per_language rows of each language.
    sample = rows.join(F.broadcast(chosen.distinct()), ["id", "lang"], "left_semi")
    count_words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counted = sample.select("lang", count_words.alias("word")).groupBy("lang", "word").count()

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        p = learn(Pieces(pieces), part["word"].tolist(), part["count"].to_numpy())
        return pd.DataFrame({"lang": part["lang"].iloc[0], "piece": np.arange(len(p)), "p": p})

    learned = counted.groupBy("lang").applyInPandas(fit, "lang string, piece int, p double")
    # One row per language: as many numbers as the fixed vocabulary has pieces.
    tables = (
        learned.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("piece", "p"))).alias("x"))
        .select("lang", F.col("x.p").alias("p")).orderBy("lang").collect()
    )
    return Model(
        [r.lang for r in tables], pieces, np.array([r.p for r in tables]).T.reshape(len(pieces), len(tables))
    )


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, lang_pred, score, words`` for every row.

    ``score`` is the probability of the language given the whole text, all
    languages being equally likely before. A text that is NULL, empty or without
    letters gets ``und`` and 0; so does every text if no language was learned.
    Ties go to the language that sorts first. Rows may repeat; NULL ids stay;
    other columns are left out.
    """
    kept = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        sums, sizes = model.scorer()(batch.column(1).to_pylist())
        names = np.array([*model.languages, "und"], object)
        if model.languages:
            best = sums.argmax(1)
            part = 1.0 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        else:
            best, part = np.zeros(len(sizes), int), np.zeros(len(sizes))
        best[sizes == 0] = len(names) - 1
        part[sizes == 0] = 0.0
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names[best], pa.string()), pa.array(part), pa.array(sizes)],
            [id_col, "lang_pred", "score", "words"],
        )

    kind = kept.schema[id_col].dataType.simpleString()
    return over_slices(kept, "text", work, f"`{id_col}` {kind}, lang_pred string, score double, words long")


def relabel(
    docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` whose text has letters, with all their columns and
    the language found in ``lang_col``. One pass over the rows, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        sums, sizes = model.scorer()(batch.column(text_col).to_pylist())
        keep = sizes > 0
        if model.languages:
            names = np.array(model.languages, object)[sums.argmax(1)]
            at = batch.schema.get_field_index(lang_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(names, pa.string()))
        return batch.filter(pa.array(keep))

    return over_slices(docs, text_col, work, docs.schema)


def model_for(spark: SparkSession, docs: DataFrame, path: str) -> Model:
    """A model over the pieces of a public sentencepiece file."""
    return train(docs, read_pieces(path))
