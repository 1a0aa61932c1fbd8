"""CRC-32 of many overlapping spans of a byte buffer, by tables of positions.

But for a constant that only depends on the length, CRC-32 is linear: each byte
contributes a value that depends on the byte and its distance from the end, and
the contributions are added by XOR. All contributions are looked up at once and
``bitwise_xor.reduceat`` adds them over each span. A span longer than the table
is cut into blocks from its end; pairs of blocks are folded, the front one
shifted over the length of the rear one, until one is left.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, least significant bit first
ONES = np.uint32(0xFFFFFFFF)
# Distances in the table, a power of two; longest span that is looked up at once.
REACH = 128
# Bytes looked up at once.
CHUNK = 1 << 17


def _byte_table() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        codes = np.where(codes & 1, (codes >> 1) ^ np.uint32(POLYNOMIAL), codes >> 1)
    return codes.astype(np.uint32)


BYTE = _byte_table()


def _one_byte(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint32(8)) ^ BYTE[x & np.uint32(0xFF)]


def _position_table() -> np.ndarray:
    """What byte b adds if d bytes follow: row d, column b."""
    rows = [BYTE]
    for _ in range(REACH - 1):
        rows.append(_one_byte(rows[-1]))
    return np.concatenate(rows)


PLACES = _position_table()


class _Shift:
    """A register moved over a number of zero bytes: linear, so by its four bytes."""

    def __init__(self, tables: np.ndarray) -> None:
        self.tables = tables

    def __call__(self, x: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[0][x & 0xFF] ^ t[1][x >> 8 & 0xFF] ^ t[2][x >> 16 & 0xFF] ^ t[3][x >> 24]

    def twice(self) -> _Shift:
        return _Shift(self(self.tables))


def _shifts(n: int) -> list[_Shift]:
    """Over 1, 2, 4 ... bytes."""
    byte = np.arange(256, dtype=np.uint32)
    found = [_Shift(np.stack([_one_byte(byte << np.uint32(8 * k)) for k in range(4)]))]
    while len(found) < n:
        found.append(found[-1].twice())
    return found


SHIFTS = _shifts(40)
FOLD = REACH.bit_length() - 1  # the shift over a block


def _length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes."""
    x = np.full(len(lengths), ONES)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        odd = lengths >> k & 1 == 1
        x[odd] = SHIFTS[k](x[odd])
    return x ^ ONES


CONSTANTS = _length_constants(np.arange(REACH + 1))


def _looked_up(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of contributions, each span's in as many parts as ``cuts`` (positions
    in the spans laid end to end) asks for."""
    behind = np.repeat(np.cumsum(lengths).astype(np.int32), lengths)
    behind -= np.arange(1, len(behind) + 1, dtype=np.int32)  # bytes up to the span's end
    at = np.repeat(ends - 1, lengths) - behind
    return np.bitwise_xor.reduceat(PLACES[(behind << 8) + data[at]], cuts)


def _chunks(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of spans that hold about CHUNK bytes, one span at least."""
    total = np.cumsum(lengths)
    found, lo = [], 0
    while lo < len(lengths):
        before = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + CHUNK, "right")))
        found.append((lo, hi))
        lo = hi
    return found


def crc_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[starts[i]:ends[i]]``; no span is empty."""
    lengths = ends - starts
    blocks = -(-lengths // REACH)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    # Blocks of a span in order; ``back`` counts them from its end.
    back = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(owner))
    block_ends = ends[owner] - back * REACH
    block_lengths = np.minimum(REACH, block_ends - starts[owner])
    parts = [np.zeros(0, np.uint32)]
    for lo, hi in _chunks(block_lengths):
        n = block_lengths[lo:hi]
        parts.append(_looked_up(data, block_ends[lo:hi], n, np.cumsum(n) - n))
    sums = np.concatenate(parts)
    level = FOLD
    while len(sums) > len(lengths):
        odd = back & 1 == 1
        sums[odd] = SHIFTS[level](sums[odd])
        back = back >> 1
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (back[1:] != back[:-1])]))
        sums, owner, back, level = np.bitwise_xor.reduceat(sums, new), owner[new], back[new], level + 1
    return sums ^ _length_constants(lengths)


def crc_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """CRC-32 of the runs of 1 to ``most`` words that end at each word: a row for
    each word, a column for each number of words; 0 where the text has no such run.

    ``first`` is the first word of each word's text. Runs that end together share
    the distances of their bytes, so the longest is looked up once and cut at its
    words; what the parts add up to from the end are the shorter runs.
    """
    n = len(starts)
    word = np.arange(n)
    oldest = np.maximum(first, word - most + 1)
    out = np.zeros((n, most), np.uint32)
    short = ends - starts[oldest] <= REACH
    for lo, hi in _chunks(np.where(short, ends - starts[oldest], 0)):
        mine = lo + np.flatnonzero(short[lo:hi])
        if not len(mine):
            continue
        size = mine - oldest[mine] + 1
        begin, length = starts[oldest[mine]], ends[mine] - starts[oldest[mine]]
        owner = np.repeat(np.arange(len(mine)), size)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        from_start = starts[oldest[mine][owner] + nth] - begin[owner]
        cuts = (np.cumsum(length) - length)[owner] + from_start
        parts = _looked_up(data, ends[mine], length, cuts)
        words = (size[owner] - nth).astype(np.int64)  # of the run that begins at the cut
        table = np.zeros((len(mine), most), np.uint32)
        table[owner, words - 1] = parts
        table = np.bitwise_xor.accumulate(table, axis=1)
        lengths = np.zeros((len(mine), most), np.int64)
        lengths[owner, words - 1] = length[owner] - from_start
        out[mine] = np.where(lengths > 0, table ^ CONSTANTS[lengths], 0)
    long = np.flatnonzero(~short)
    for k in range(most):
        mine = long[long - k >= first[long]]
        if len(mine):
            out[mine, k] = crc_of_spans(data, starts[mine - k], ends[mine])
    return out
