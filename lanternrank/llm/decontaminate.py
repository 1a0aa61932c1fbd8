"""Benchmark decontamination: items found in documents within an error budget.

An item of m words may differ in k = floor(rate * m) words, counted as edit
distance over words. Cut into k + 1 pieces, at least one of them must then occur
without an error. All pieces of a block of items are searched in one pass over
each document, and the text around each hit is compared with the whole item by
Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternrank.llm.shared import over_slices

# Words of an item that may be wrong; the nearness of other near-duplicate steps.
ERROR_RATE = 0.2
# Items of fewer words have to occur without an edit.
FEWEST = 8
# Bytes of item text searched in one pass over the documents.
BLOCK_BYTES = 8 << 20
# Items whose ids are told to all tasks.
FEW_ITEMS = 1 << 18

SEPARATORS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, one space around and between words of letters and digits."""
    return f" {SEPARATORS.sub(' ', text.lower())} ".replace("  ", " ") if text else " "


def pieces_of(words: list[str], errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, each with the place of its first word."""
    n = errors + 1
    cuts = [k * len(words) // n for k in range(n + 1)]
    return [(a, f" {' '.join(words[a:b])} ") for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(masks: dict[str, int], m: int, text: list[str], budget: int) -> tuple[int, int] | None:
    """Least edit distance of a pattern of m words to any part of ``text``, and
    the last word of that part, if within the budget; Myers' algorithm.

    ``masks`` has for each word of the pattern the bits of its places.
    """
    ones, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = ones, 0, m, None
    for at, word in enumerate(text):
        eq = masks.get(word, 0)
        x = eq | down
        d0 = ((((eq & up) + up) ^ up) | x) & ones
        hp = (down | ~(d0 | up)) & ones
        hn = up & d0
        score += bool(hp & last) - bool(hn & last)
        hp, hn = (hp << 1) & ones, (hn << 1) & ones
        up = (hn | ~(d0 | hp)) & ones
        down = hp & d0
        if score <= budget and (best is None or score < best[0]):
            best = score, at
    return best


class Finder:
    """The pieces of a block of items, and what is needed to verify a hit."""

    def __init__(self, items: list[tuple], rate: float, fewest: int):
        import ahocorasick

        self.items = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            words = normal(text).split()
            if not words:
                continue
            errors, masks = int(rate * len(words)) if len(words) >= fewest else 0, {}
            for k, w in enumerate(words):
                masks[w] = masks.get(w, 0) | 1 << k
            for start, piece in pieces_of(words, errors):
                hits.setdefault(piece, []).append((len(self.items), start))
            self.items.append((item, len(words), errors, masks))
        self.pieces = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.pieces.add_word(piece, (len(piece), where))
        self.pieces.make_automaton()

    def __call__(self, text: str | None) -> list[tuple]:
        """``item, distance, words of the item, first word, last word`` of each
        item found, at its best place; ties go to the first."""
        if not self.items:
            return []
        text = normal(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        words, counted, upto = None, 0, 0
        for end, (size, where) in self.pieces.iter(text):
            if words is None:
                words = text.split()
            start = end - size + 1
            if start >= upto:
                counted += text.count(" ", upto, start)
            else:
                counted -= text.count(" ", start, upto)
            upto, first = start, counted
            for k, offset in where:
                _, m, errors, _ = self.items[k]
                low = max(0, first - offset - errors)
                high = min(len(words), first - offset + m + errors)
                mine = windows.setdefault(k, [])
                if mine and mine[-1][0] <= low <= mine[-1][1]:
                    mine[-1] = mine[-1][0], max(mine[-1][1], high)
                else:
                    mine.append((low, high))
        found = []
        for k, places in windows.items():
            item, m, errors, masks = self.items[k]
            best = None
            for low, high in _merged(places):
                match = best_match(masks, m, words[low:high], errors)
                if match and (best is None or match[0] < best[0]):
                    best = match[0], low + match[1]
            if best:
                found.append((item, best[0], m, max(0, best[1] - m + 1), best[1]))
        return found


def _merged(windows: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Windows in order, those that overlap as one: no word is searched twice."""
    low = high = None
    for a, b in sorted(windows):
        if low is None or a > high:
            if low is not None:
                yield low, high
            low, high = a, b
        high = max(high, b)
    if low is not None:
        yield low, high


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Distinct items in blocks whose text is bounded; one block for most benchmarks."""
    items = items.groupBy("text").agg(F.first("item").alias("item")).select("item", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items
        yield [tuple(r) for r in block.collect()]


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    rate: float = ERROR_RATE,
    fewest: int = FEWEST,
) -> DataFrame:
    """``id, item, distance, item_words, first_word, last_word``: every document
    row and item whose words occur in the document's whole text with at most
    ``floor(rate * item_words)`` word edits, once each, at the best place.

    Case, punctuation and white space make no difference. Items of fewer than
    ``fewest`` words have to occur without an edit. NULL and empty texts match
    nothing; repeated rows and repeated items match each for itself. Items of one
    text are searched once, in blocks of bounded size, each block one pass over
    the documents. A text costs its length, and for each item with a hit the
    words around its hits, however many and whatever they overlap.
    """
    kept = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    asked = asked.select("item", F.xxhash64("text").alias("name"), "text")
    distinct = asked.select(F.col("name").alias("item"), "text")
    names = ["id", "name", "distance", "item_words", "first_word", "last_word"]
    schema = f"id {kept.schema[id_col].dataType.simpleString()}, name long, distance int, item_words int, first_word long, last_word long"
    parts = []
    for block in _blocks(distinct):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        parts.append(over_slices(kept, "text", _search(shared, rate, fewest, names), schema))
    listed = asked.select("name", "item")
    listed = F.broadcast(listed) if asked.count() <= FEW_ITEMS else listed
    found = reduce(DataFrame.unionByName, parts).join(listed, "name")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), *names[2:])


def _search(shared, rate: float, fewest: int, names: list[str]):
    finder = None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        nonlocal finder
        if finder is None:
            finder = Finder(shared.value, rate, fewest)
        rows, found = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            for match in finder(text):
                rows.append(k)
                found.append(match)
        if not found:
            return None
        columns = [pa.array(list(c)) for c in zip(*found, strict=True)]
        types = [None, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        cast = [c if t is None else c.cast(t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *cast], names)

    return work


def clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text",
    rate: float = ERROR_RATE, fewest: int = FEWEST,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item occurs
    in the sense of ``matches``. One pass for each block of items, no shuffle."""
    asked = items.select(F.lit(0).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    for block in _blocks(asked):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = over_slices(docs, text_col, _keep(shared, rate, fewest, text_col), docs.schema)
    return docs


def _keep(shared, rate: float, fewest: int, column: str):
    finder = None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal finder
        if finder is None:
            finder = Finder(shared.value, rate, fewest)
        return batch.filter(pa.array([not finder(t) for t in batch.column(column).to_pylist()], pa.bool_()))

    return work
