"""NumPy work on one block of queries and the candidates streaming past it.

A score is a cosine in double precision. It is compared after rounding to nine
places, as a whole number of *ticks*, so that equal scores are equal on every
machine. Order is by score, best first, then by id.

Most pairs are settled in single precision, by one comparison with a bound per
query. The error of a single-precision product of unit vectors has a known limit;
pairs that lie within it, or above the bound, are computed again in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lanternrank.operators.sweep import GROUP, Kernel

TICKS_PER_UNIT = 10**9
_NO_ID = (1 << 63) - 1
_ROWS, _COLUMNS = 256, 1024     # one tile of the score matrix: 2 MiB, stays in cache
_FEW = 64                       # one in so many columns is computed singly
_FEW_AHEAD = 64                 # one in so many candidates is looked at once more
_PENDING = 1 << 18              # candidates gathered before a top-k list is updated
_OUT_ROWS = 1 << 16             # rows per result batch
_PAIR_VALUES = 1 << 20          # components of pairs with one key scored at once
_MANY_PAIRS, _FEW_OF_KEY = 1 << 12, 8  # pairs of a key worth tiles of their own; rows of either side


def unit_vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and pc.count_distinct(pc.list_value_length(column)).as_py() != 1:
        raise ValueError("vectors differ in length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1)
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def integers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(False)


def _positions(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true entries; faster than a 2-D nonzero."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def pair_ticks(a: pa.Array, b: pa.Array) -> pa.Array:
    """Scores of two columns of vectors, row by row, in ticks."""
    x, y = unit_vectors(a), unit_vectors(b)
    return pa.array(np.rint(np.einsum("ij,ij->i", x * TICKS_PER_UNIT, y)).astype(np.int64))


class _Scoring(Kernel):
    def start(self, resident: pa.Table) -> None:
        self.group = resident[GROUP][0].as_py()
        self.ids = integers(resident["id"])
        unit = unit_vectors(resident["embedding"])
        self.vectors = unit * TICKS_PER_UNIT
        self.coarse = unit.astype(np.float32)
        # Rounding the inputs, summing in any order, and rounding the bound.
        self.margin = (unit.shape[1] + 10) * 2.0**-24

    def bound(self, ticks: np.ndarray, side: int) -> np.ndarray:
        """A column of scores that is safely below (-1) or above (+1) these."""
        score = (ticks + side * 0.5) / TICKS_PER_UNIT + side * self.margin
        return score.astype(np.float32)[:, None]

    def tiles(
        self, part: pa.RecordBatch, queries: np.ndarray
    ) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Tiles of scores in the precision and scale of ``queries``: query
        slice, candidate positions, ids, vectors, scores. Candidates come in id
        order; the scores are overwritten by the next tile.
        """
        ids = integers(part.column("id"))
        vectors = unit_vectors(part.column("embedding"))
        by_id = np.argsort(ids)
        tile = np.empty(_ROWS * _COLUMNS, queries.dtype)
        for lo in range(0, len(ids), _COLUMNS):
            where = by_id[lo : lo + _COLUMNS]
            block = vectors[where]
            right = block.T.astype(queries.dtype)
            for top in range(0, len(self.ids), _ROWS):
                rows = slice(top, min(top + _ROWS, len(self.ids)))
                shape = (rows.stop - top, len(where))
                scores = tile[: shape[0] * shape[1]].reshape(shape)
                np.matmul(queries[rows], right, out=scores)
                yield rows, where, ids[where], block, scores

    def exact(self, rows: slice | np.ndarray, block: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Ticks of chosen pairs of a tile; rows with many are done whole."""
        mine = self.vectors[rows]
        crowded = np.bincount(row, minlength=len(mine)) > len(block) // _FEW
        whole = crowded[row]
        few = ~whole
        ticks = np.empty(len(row))
        ticks[few] = np.einsum("ij,ij->i", mine[row[few]], block[col[few]])
        if whole.any():
            at = np.cumsum(crowded) - 1
            ticks[whole] = (mine[crowded] @ block.T)[at[row[whole]], col[whole]]
        return np.rint(ticks)

    def batch(self, rows: int, **columns: np.ndarray) -> pa.RecordBatch:
        group = pa.array([self.group] * rows, pa.string())
        return pa.RecordBatch.from_arrays(
            [group, *(pa.array(c) for c in columns.values())], [GROUP, *columns]
        )


class TopK(_Scoring):
    """The k best candidates of every query.

    A resident column ``floor`` may say, in ticks, what k candidates are known
    to reach; what lies below it is not kept.
    """

    SCHEMA = f"{GROUP} string, query_id bigint, passage_id bigint, ticks bigint"
    BYTES_PER_K = 40  # of state per query, gathered candidates included
    ROW_BYTES = 32    # of a row that is returned

    def __init__(self, k: int) -> None:
        super().__init__()
        self.k = k

    def start(self, resident: pa.Table) -> None:
        super().start(resident)
        n = len(self.ids)
        self.best = np.full((n, self.k), -np.inf)
        self.best_ids = np.full((n, self.k), _NO_ID)
        self.worst = np.full(n, -np.inf)     # score and id to beat
        self.worst_id = np.full(n, _NO_ID)
        if "floor" in resident.column_names:
            known = resident["floor"].cast(pa.float64()).fill_null(-np.inf)
            self.worst = known.to_numpy().copy()
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_pending = 0

    def feed(self, part: pa.RecordBatch) -> None:
        for rows, _, ids, block, scores in self.tiles(part, self.coarse):
            row, col = _positions(scores >= self.bound(self.worst[rows], -1))
            if not len(row):
                continue
            ticks, found = self.exact(rows, block, row, col), ids[col]
            row += rows.start
            worst = self.worst[row]
            better = (ticks > worst) | ((ticks == worst) & (found < self.worst_id[row]))
            self.pending.append((row[better], ticks[better], found[better]))
            self.n_pending += int(better.sum())
            if self.n_pending > max(_PENDING, self.best.size):
                self.settle()

    def settle(self) -> None:
        """Merge what was gathered into the lists."""
        if not self.pending:
            return
        row, ticks, ids = (np.concatenate(x) for x in zip(*self.pending))
        self.pending, self.n_pending = [], 0
        order = np.argsort(row, kind="stable")
        row, ticks, ids = row[order], ticks[order], ids[order]
        touched, starts = np.unique(row, return_index=True)
        for q, lo, hi in zip(touched, starts, [*starts[1:], len(row)]):
            t = np.concatenate([self.best[q], ticks[lo:hi]])
            i = np.concatenate([self.best_ids[q], ids[lo:hi]])
            cut = np.partition(t, -self.k)[-self.k]
            above, equal = np.flatnonzero(t > cut), np.flatnonzero(t == cut)
            room = self.k - len(above)
            if room < len(equal):
                equal = equal[np.argpartition(i[equal], room - 1)[:room]]
            chosen = np.concatenate([above, equal])
            self.best[q], self.best_ids[q] = t[chosen], i[chosen]
            if cut >= self.worst[q]:
                self.worst[q], self.worst_id[q] = cut, i[equal].max()

    def finish(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        step = max(1, _OUT_ROWS // self.k)
        for top in range(0, len(self.ids), step):
            found = self.best[top : top + step] > -np.inf
            owner = np.repeat(self.ids[top : top + step], found.sum(axis=1))
            yield self.batch(
                len(owner),
                query_id=owner,
                passage_id=self.best_ids[top : top + step][found],
                ticks=self.best[top : top + step][found].astype(np.int64),
            )


class BestMatch(_Scoring):
    """The best candidate that shares the query's key; only such pairs are scored.

    Keys of many queries and candidates are scored in tiles, like a search: what
    single precision tells to be behind the best so far is left there.
    """

    SCHEMA = f"{GROUP} string, query_id bigint, gold_id bigint, gold_ticks bigint"

    def start(self, resident: pa.Table) -> None:
        super().start(resident)
        self.keys = pc.unique(resident["key"])
        codes = integers(pc.index_in(resident["key"], self.keys))
        self.by_key = np.argsort(codes, kind="stable")     # queries, key by key
        self.first = np.searchsorted(codes[self.by_key], np.arange(len(self.keys) + 1))
        self.best = np.full(len(self.ids), -np.inf)
        self.best_ids = np.full(len(self.ids), _NO_ID)

    def feed(self, part: pa.RecordBatch) -> None:
        part = part.filter(pc.is_in(part.column("key"), self.keys))
        if part.num_rows == 0:
            return
        codes = integers(pc.index_in(part.column("key"), self.keys))
        ids, vectors = integers(part.column("id")), unit_vectors(part.column("embedding"))
        offered = np.bincount(codes, minlength=len(self.keys))
        asked = np.diff(self.first)
        many = (offered * asked >= _MANY_PAIRS) & (np.minimum(offered, asked) >= _FEW_OF_KEY)
        for code in np.flatnonzero(many):
            mine = np.flatnonzero(codes == code)
            self._score_key(self.by_key[self.first[code] : self.first[code + 1]], ids[mine], vectors[mine])
        if many.any():
            rest = np.flatnonzero(~many[codes])
            codes, ids, vectors = codes[rest], ids[rest], vectors[rest]
        ends = np.cumsum(self.first[codes + 1] - self.first[codes])
        # A slice has so many pairs, or is one candidate and its key's queries.
        step, lo = max(1, _PAIR_VALUES // vectors.shape[1]), 0
        while lo < len(ids):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + step, "right")))
            self._score(codes[lo:hi], ids[lo:hi], vectors[lo:hi], step)
            lo = hi

    def _score_key(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """All pairs of some queries and candidates; the lower id wins among equals."""
        by_id = np.argsort(ids)
        ids, vectors = ids[by_id], vectors[by_id]
        for lo in range(0, len(ids), _COLUMNS):
            block, names = vectors[lo : lo + _COLUMNS], ids[lo : lo + _COLUMNS]
            right = block.T.astype(np.float32)
            for top in range(0, len(queries), _ROWS):
                rows = queries[top : top + _ROWS]
                scores = self.coarse[rows] @ right
                # A query's best of this tile, and what may be as good, are told exactly.
                most = scores.max(axis=1, keepdims=True) - np.float32(2 * self.margin)
                floor = np.maximum(self.bound(self.best[rows], -1), most)
                row, col = _positions(scores >= floor)
                if not len(row):
                    continue
                ticks, found = self.exact(rows, block, row, col), names[col]
                # Rows come in order, columns by id: the first of the best is the lowest.
                order = np.lexsort((found, -ticks, row))
                first = order[np.unique(row[order], return_index=True)[1]]
                q, t, i = rows[row[first]], ticks[first], found[first]
                won = (t > self.best[q]) | ((t == self.best[q]) & (i < self.best_ids[q]))
                self.best[q[won]], self.best_ids[q[won]] = t[won], i[won]

    def _score(self, codes: np.ndarray, ids: np.ndarray, vectors: np.ndarray, step: int) -> None:
        counts = self.first[codes + 1] - self.first[codes]
        col = np.repeat(np.arange(len(ids)), counts)
        at = np.arange(len(col)) + np.repeat(self.first[codes] - (np.cumsum(counts) - counts), counts)
        row = self.by_key[at]
        for lo in range(0, len(row), step):
            r, c = row[lo : lo + step], col[lo : lo + step]
            ticks = np.rint(np.einsum("ij,ij->i", self.vectors[r], vectors[c]))
            order = np.lexsort((ids[c], -ticks, r))
            first = order[np.unique(r[order], return_index=True)[1]]  # the best of each query
            q, t, i = r[first], ticks[first], ids[c[first]]
            won = (t > self.best[q]) | ((t == self.best[q]) & (i < self.best_ids[q]))
            self.best[q[won]], self.best_ids[q[won]] = t[won], i[won]

    def finish(self) -> Iterator[pa.RecordBatch]:
        found = np.isfinite(self.best)
        yield self.batch(
            int(found.sum()),
            query_id=self.ids[found],
            gold_id=self.best_ids[found],
            gold_ticks=self.best[found].astype(np.int64),
        )


class CountAhead(_Scoring):
    """How many candidates rank ahead of each query's best match."""

    SCHEMA = f"{GROUP} string, query_id bigint, ahead bigint"

    def start(self, resident: pa.Table) -> None:
        super().start(resident)
        self.gold = integers(resident["gold_ticks"]).astype(np.float64)
        self.gold_ids = integers(resident["gold_id"])
        self.ahead = np.zeros(len(self.ids), np.int64)

    def feed(self, part: pa.RecordBatch) -> None:
        for rows, _, ids, block, scores in self.tiles(part, self.coarse):
            gold, gold_ids = self.gold[rows], self.gold_ids[rows]
            open_ = scores >= self.bound(gold, -1)
            if np.count_nonzero(open_) * _FEW_AHEAD > open_.size:
                above = scores > self.bound(gold, 1)
                self.ahead[rows] += np.count_nonzero(above, axis=1)
                row, col = _positions(open_ & ~above)
            else:
                # Few come near: only those are looked at once more.
                row, col = _positions(open_)
                above = scores[row, col] > self.bound(gold, 1)[row, 0]
                self.ahead[rows] += np.bincount(row[above], minlength=len(gold))
                row, col = row[~above], col[~above]
            ticks, found = self.exact(rows, block, row, col), ids[col]
            before = (ticks > gold[row]) | ((ticks == gold[row]) & (found < gold_ids[row]))
            before &= found != gold_ids[row]
            self.ahead[rows] += np.bincount(row[before], minlength=len(gold))

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield self.batch(len(self.ids), query_id=self.ids, ahead=self.ahead)
