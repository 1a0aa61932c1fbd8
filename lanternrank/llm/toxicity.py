"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over the stems of labelled examples, with document
frequencies of the whole corpus. The nearest examples by exact cosine come from
an inverted index in blocks: the largest weight of each term in a block bounds
the cosine with any of its examples, and blocks that cannot reach the nearest
found so far are never opened. Votes weighted by similarity, corrected for the
sample's class sizes, give the score; the examples are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.shared import held_out, over_slices, slices

# Labelled examples of each class that are learned from, those of the smallest hash.
EXAMPLES = 1024
NEAREST = 16
THRESHOLD = 0.3
STEM = 5
BLOCK = 64
# A term in more than one in so many examples has an array instead of a list.
SPARSE = 32
# Terms and cosines, in single precision, of texts that are worked on together.
TOGETHER = 1 << 21
WORDS = re.compile(r"[^\W\d_]+")
# The same words of plain ASCII: what is no letter becomes a space.
_ASCII = {k: chr(k).lower() if chr(k).isalpha() else " " for k in range(128)}


def _starts(text: str) -> list[str]:
    """The first letters of every word, in lower case."""
    words = text.translate(_ASCII).split() if text.isascii() else WORDS.findall(text.lower())
    return [w[:STEM] for w in words]


def stems(text: str | None) -> Counter:
    """The first letters of every word, in lower case, counted."""
    return Counter(_starts(text)) if text else Counter()


def stem_set(text: str | None) -> set[str]:
    return set(_starts(text)) if text else set()


class Index:
    """Example vectors in blocks, by term within a block."""

    def __init__(self, examples: list[tuple], idf: dict[str, float], share: float):
        """``examples`` has id, label and counted stems; ``share`` is that of
        label 1 among all labelled rows."""
        self.share = share
        self.terms = {t: k for k, t in enumerate(sorted(idf))}
        self.idf = np.array([idf[t] for t in sorted(idf)])
        vectors = [self.vector(c) for _, _, c in examples]
        order = self._order(vectors)
        self.ids = [examples[k][0] for k in order]
        self.labels = np.array([examples[k][1] for k in order], int)
        self.sizes = np.bincount(self.labels, minlength=2)
        n, v = len(order), len(self.terms)
        self.blocks = -(-n // BLOCK)
        sizes = [len(vectors[k][0]) for k in order]
        row = np.repeat(np.arange(n), sizes)
        # Vectors of the examples, one after the other.
        self.example_terms = np.concatenate([*(vectors[k][0] for k in order), np.zeros(0, int)]).astype(int)
        self.example_weights = np.concatenate([*(vectors[k][1] for k in order), np.zeros(0)])
        self.ends = np.cumsum([0, *sizes])
        term, weight, block = self.example_terms, self.example_weights, row // BLOCK
        self.most = np.zeros((v, self.blocks))
        np.maximum.at(self.most, (term, block), weight)
        # Lists of a term are arrays over all examples if they would be long.
        times = np.bincount(term, minlength=v)
        often = times * SPARSE >= n
        self.array_of = np.where(often, np.cumsum(often) - 1, -1)
        self.arrays = np.zeros((int(often.sum()), self.blocks * BLOCK), np.float32)
        some = often[term]
        self.arrays[self.array_of[term[some]], row[some]] = weight[some]
        by = np.lexsort((row[~some], term[~some]))
        self.rows, self.weights = row[~some][by], weight[~some][by].astype(np.float32)
        self.starts = np.searchsorted(term[~some][by], np.arange(v + 1))

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights ``(1 + ln tf) idf``."""
        term = np.fromiter(map(self.terms.get, counts, repeat(-1)), int, len(counts))
        n = np.fromiter(counts.values(), int, len(counts))[term >= 0]
        term = term[term >= 0]
        if not len(term):
            return np.zeros(0, int), np.zeros(0)
        weight = (1 + np.log(n)) * self.idf[term]
        norm = np.sqrt((weight**2).sum())
        return (term, weight / norm) if norm > 0 else (term[:0], weight[:0])

    def _order(self, vectors: list) -> list[int]:
        """Examples along the second direction of their similarities, so that
        those of one language share blocks and the bounds are tight."""
        n, v = len(vectors), len(self.terms)
        row = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        term = np.concatenate([*(t for t, _ in vectors), np.zeros(0, int)]).astype(int)
        weight = np.concatenate([*(w for _, w in vectors), np.zeros(0)])
        x = np.cos(np.arange(n) * 2.4)
        for _ in range(30):
            x = x - x.sum() / max(n, 1)
            x = np.bincount(row, weight * np.bincount(term, weight * x[row], v)[term], n)
            x = x / (np.abs(x).max() or 1.0) if n else x
        return np.argsort(x, kind="stable").tolist()

    def _rough(self, term: np.ndarray, weight: np.ndarray, open_blocks: np.ndarray) -> np.ndarray:
        """Cosines in single precision with the examples of some blocks, in order."""
        array = self.array_of[term]
        dense = array >= 0
        columns = slice(None)
        if len(open_blocks) < self.blocks:
            columns = (open_blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        arrays = self.arrays[array[dense]] if len(open_blocks) * 2 > self.blocks else self.arrays[np.ix_(array[dense], columns)]
        out = weight[dense].astype(np.float32) @ arrays
        if arrays.shape[1] == self.arrays.shape[1]:
            out = out[columns]
        rare = term[~dense]
        start, size = self.starts[rare], self.starts[rare + 1] - self.starts[rare]
        where = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        each = np.repeat(weight[~dense], size)
        return out + np.bincount(self.rows[where], self.weights[where] * each, self.blocks * BLOCK)[columns]

    def _exact(self, whole: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Cosines with a few examples in double precision; ``whole`` has the
        weight of every term."""
        spans = [slice(a, b) for a, b in zip(self.ends[places].tolist(), self.ends[places + 1].tolist(), strict=True)]
        if not spans:
            return np.zeros(0)
        term = np.concatenate([self.example_terms[x] for x in spans])
        weight = np.concatenate([self.example_weights[x] for x in spans])
        owner = np.repeat(np.arange(len(places)), self.ends[places + 1] - self.ends[places])
        return np.bincount(owner, whole[term] * weight, len(places))

    def nearest(self, counts: Counter, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a term in common;
        ties go to the earlier place.

        The block of the largest bound gives a cosine to reach; blocks whose
        bound is below it are not opened. Cosines of the others are computed in
        single precision, whose error has a known limit, and those that may be
        among the nearest once more.
        """
        term, weight = self.vector(counts)
        n = len(self.ids)
        if not len(term) or not n:
            return np.zeros(0, int), np.zeros(0)
        margin = (len(term) + 20) * 2.0**-23
        bound = weight @ self.most[term]
        opened = np.argsort(-bound, kind="stable")[: -(-k // BLOCK)]
        if self.blocks > len(opened):
            rough = self._rough(term, weight, opened)
            least = np.partition(rough, -k)[-k] - margin
            opened = np.flatnonzero((bound >= least - 1e-9) & (bound > 0))
        opened = np.sort(opened)
        places = (opened[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        rough = self._rough(term, weight, opened)
        rough, places = rough[places < n], places[places < n]
        least = np.partition(rough, -k)[-k] - 2 * margin if len(rough) > k else 0.0
        whole = np.zeros(len(self.terms))
        whole[term] = weight
        return self._best(whole, places[(rough >= least) & (rough > 0)], k)

    def _best(self, whole: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        cosines = self._exact(whole, places)
        best = np.lexsort((places, -cosines.round(12)))[:k]
        best = best[cosines[best] > 0]
        return places[best], cosines[best]

    def nearest_of(self, texts: list[Counter], k: int = NEAREST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``nearest`` finds for each of some texts, worked on together: a
        block is opened once for all texts that it may be near to."""
        vectors = [self.vector(c) for c in texts]
        n, width = len(self.ids), self.blocks * BLOCK
        asked = [at for at, (term, _) in enumerate(vectors) if len(term)] if n else []
        none = np.zeros(0, int), np.zeros(0)
        found = [none] * len(texts)
        # Two matrices of a row for each text, of its terms and its cosines.
        step = max(1, TOGETHER // max(1, width + len(self.arrays)))
        for lo in range(0, len(asked), step):
            some = asked[lo : lo + step]
            for at, hits in zip(some, self._nearest_of([vectors[at] for at in some], k), strict=True):
                found[at] = hits
        yield from found

    def _nearest_of(self, vectors: list, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m, n, width = len(vectors), len(self.ids), self.blocks * BLOCK
        sizes = np.array([len(term) for term, _ in vectors])
        margin = (sizes + 20) * 2.0**-23
        bound = np.stack([weight @ self.most[term] for term, weight in vectors])
        row = np.repeat(np.arange(m), sizes)
        term, weight = (np.concatenate(x) for x in zip(*vectors, strict=True))
        array = self.array_of[term]
        dense = array >= 0
        asked = np.zeros((m, len(self.arrays)), np.float32)
        asked[row[dense], array[dense]] = weight[dense]
        rare = term[~dense]
        start, size = self.starts[rare], self.starts[rare + 1] - self.starts[rare]
        where = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        place = np.repeat(row[~dense] * width, size) + self.rows[where]
        each = self.weights[where] * np.repeat(weight[~dense], size)
        lists = np.bincount(place, each, m * width).astype(np.float32).reshape(m, self.blocks, BLOCK)
        rough = np.full((m, self.blocks, BLOCK), -np.inf, np.float32)

        def look(pairs: np.ndarray) -> None:
            for block in np.flatnonzero(pairs.any(axis=0)):
                mine = np.flatnonzero(pairs[:, block])
                arrays = self.arrays[:, block * BLOCK : (block + 1) * BLOCK]
                rough[mine, block] = asked[mine] @ arrays + lists[mine, block]

        first = np.zeros((m, self.blocks), bool)
        opened = np.argsort(-bound, axis=1, kind="stable")[:, : -(-k // BLOCK)]
        np.put_along_axis(first, opened, True, axis=1)
        look(first)
        flat = rough.reshape(m, width)
        wanted = first
        if self.blocks > opened.shape[1]:
            near = rough[np.arange(m)[:, None], opened].reshape(m, -1)
            least = np.partition(near, -k, axis=1)[:, -k] - margin
            wanted = (bound >= least[:, None] - 1e-9) & (bound > 0)
            look(wanted & ~first)
            rough[first & ~wanted] = -np.inf
        flat[:, n:] = -np.inf
        least = np.zeros(m)
        if n > k:
            # Fewer than k opened ones are all looked at.
            least = np.maximum(np.partition(flat, -k, axis=1)[:, -k] - 2 * margin, 0.0)
        at, places = np.nonzero((flat >= least[:, None]) & (flat > 0))
        ends = np.searchsorted(at, np.arange(m + 1))
        whole = np.zeros(len(self.terms))
        for each, (term, weight) in enumerate(vectors):
            whole[term] = weight
            yield self._best(whole, places[ends[each] : ends[each + 1]], k)
            whole[term] = 0.0

    def score(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 in the votes, as if classes were sampled alike; the
        share of all labelled rows where nothing votes."""
        if not len(places) or not self.sizes.all():
            return float(self.share)
        votes = np.bincount(self.labels[places], cosines, 2) / self.sizes + 1e-6
        one, zero = votes[1] * self.share, votes[0] * (1 - self.share)
        return float(one / (one + zero))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    examples: int = EXAMPLES,
) -> Index:
    """An index of at most ``examples`` documents of each class.

    Learns from labels 0 and 1 of documents whose crc32(id) mod 4 is not 2, those
    whose id has the smallest hash. Document frequencies cover every document.
    Without labels of both classes every score is the share of label 1, or 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(~held_out("id")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = rows.where("id is not null and text is not null").select("id").distinct()
    known = known.join(ids, "id", "left_semi")
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(examples) for k in (0, 1)]
    # At most ``examples`` ids of each class.
    sample = F.broadcast(chosen[0].union(chosen[1]))
    few = rows.join(sample, "id").dropDuplicates(["id", "label"]).orderBy("id", "label").select("id", "label", "text").toLocalIterator()
    found = [(r.id, r.label, stems(r.text)) for r in few]
    known_stems = {t for _, _, c in found for t in c}
    names = sorted(known_stems)
    total, counts = frequencies(rows, names)
    # Every stem counts; frequent ones weigh little.
    idf = {t: float(np.log((total + 1) / (n + 1))) for t, n in zip(names, counts, strict=True)}
    every = sum(sizes.values())
    return Index(found, idf, sizes.get(1, 0) / every if every else 0.0)


def frequencies(rows: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each of the names.

    Every task counts what it reads and passes on one row for each name.
    """
    place = rows.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.value
        n = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column(0).to_pylist():
                    n[-1] += 1
                    n[[known[t] for t in known.keys() & stem_set(text)]] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["name", "n"])

    table = rows.select("text").mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(names) + 1, np.int64)
    out[table["name"].to_numpy(int)] = table["n"].to_numpy(np.int64)
    return int(out[-1]), out[:-1]


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, score, predicted, evidence`` of every row, from its whole text.

    ``evidence`` has the ids, labels and cosines of the three nearest examples.
    NULL and empty texts, and texts without a known stem, score the share of
    label 1 among labelled rows. Repeated rows and NULL ids stay; other columns
    are left out.
    """
    kept = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = kept.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        scores, evidence = [], []
        for places, cosines in index.nearest_of([stems(x) for x in batch.column(1).to_pylist()]):
            scores.append(index.score(places, cosines))
            evidence.append([
                {"example": str(index.ids[p]), "label": int(index.labels[p]), "cosine": float(c)}
                for p, c in zip(places[:3], cosines[:3], strict=True)
            ])
        predicted = pa.array([int(s >= threshold) for s in scores], pa.int32())
        shape = pa.list_(pa.struct([("example", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), predicted, pa.array(evidence, shape)],
            [id_col, "score", "predicted", "evidence"],
        )

    schema = f"`{id_col}` {kind}, score double, predicted int, evidence array<struct<example: string, label: int, cosine: double>>"
    return over_slices(kept, "text", work, schema)
