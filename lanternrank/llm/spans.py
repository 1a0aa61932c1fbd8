"""Words of many texts as spans of one byte buffer, so that runs of words can be
worked on as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from lanternrank.llm.shared import mixed

SPACE = 0x20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 0x20


def _all_but(*separators: range) -> np.ndarray:
    """For each byte, whether words have it. Bytes beyond ASCII always are in
    words, so words are the same by bytes of UTF-8 as by characters."""
    table = np.ones(256, bool)
    for each in separators:
        table[each.start : each.stop] = False
    return table


NOT_BLANK = _all_but(range(0x20, 0x21), range(0x09, 0x0E))
ALNUM = _all_but(range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)) | (LOWER != np.arange(256))


@dataclass(frozen=True)
class Words:
    """``data`` holds all words in lower case (A-Z), one space between two of a
    text; word i is ``data[start[i]:end[i]]``, and the words of text t are those
    from ``first[t]`` up to ``first[t + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words_of(texts: pa.Array, table: np.ndarray) -> Words:
    """The words of every text; NULL has none. A word does not span two texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = table[data]
    after = np.zeros(len(data), bool)  # a byte before it belongs to a word
    after[1:] = inside[:-1]
    begins = inside & ~after
    edges = bounds[1:-1][bounds[1:-1] < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    keep = inside | after
    place = np.cumsum(keep) - keep
    packed = LOWER[data[keep]]
    packed[~inside[keep]] = SPACE
    starts = np.flatnonzero(begins)
    return Words(packed, place[starts], place[np.flatnonzero(ends)] + 1, np.searchsorted(starts, bounds))


def run_bounds(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``width`` words that lie within a text, and
    how many of them each text has."""
    counts = np.maximum(np.diff(words.first) - width + 1, 0)
    shift = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(counts.sum()) + shift, counts


# A word's code is a polynomial of numbers drawn for its bytes, modulo 2**64, so
# that sums over all bytes give the codes of all words; longer words by digest.
_DRAWN = np.random.default_rng(20240229).integers(1 << 63, 1 << 64, 257, np.uint64, endpoint=False) | np.uint64(1)
LONG_WORD, CHUNK = 1 << 12, 1 << 16


def _powers(x: int) -> np.ndarray:
    steps = np.full(CHUNK + LONG_WORD + 2, x, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP = _powers(int(_DRAWN[256]))
_DOWN = _powers(pow(int(_DRAWN[256]), -1, 1 << 64))


def word_codes(words: Words) -> np.ndarray:
    """A 64-bit code of each word that depends on its bytes alone."""
    start, end = words.start, words.end
    size = end - start
    codes = np.zeros(len(start), np.uint64)
    short = size <= LONG_WORD
    at = np.flatnonzero(short)
    lo = 0
    while lo < len(at):
        base = start[at[lo]]
        hi = max(lo + 1, int(np.searchsorted(start[at], base + CHUNK, "right")))
        some = at[lo:hi]
        # Long words in between end a stretch.
        gap = np.flatnonzero(np.diff(some) > 1)
        some = some[: gap[0] + 1] if len(gap) else some
        part = _DRAWN[words.data[base : end[some[-1]]]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)])])
        codes[some] = (sums[end[some] - base] - sums[start[some] - base]) * _DOWN[start[some] - base]
        lo += len(some)
    for k in np.flatnonzero(~short):
        codes[k] = xxhash.xxh3_64_intdigest(words.data[start[k] : end[k]].tobytes())
    return mixed(codes + size.astype(np.uint64) * _DRAWN[0])
