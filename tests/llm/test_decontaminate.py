"""Matches against a brute-force edit distance over all parts of a text."""

import random
import time

from lanternrank.llm import decontaminate as d
from lanternrank.llm import queries


def brute(item, text, rate=d.ERROR_RATE, fewest=d.FEWEST):
    """Least word edits of the item to any part of the text, if within budget."""
    a, b = d.normal(item).split(), d.normal(text).split()
    if not a:
        return None
    budget = int(rate * len(a)) if len(a) >= fewest else 0
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return min(row) if min(row) <= budget else None


def cases():
    draw = random.Random(5)
    words = ["of", "the", "sea", "a", "hen", "to", "or", "ate", "ship", "was"]
    items = [" ".join(draw.choices(words, k=draw.randrange(1, 30))) for _ in range(40)]
    texts = []
    for k in range(300):
        part = draw.choice(items).split()
        for _ in range(draw.randrange(0, 8)):
            at = draw.randrange(len(part) + 1)
            part[at : at + draw.randrange(2)] = draw.choices(words, k=draw.randrange(2))
        filler = lambda: draw.choices(words + ["x", "y"], k=draw.randrange(20))
        texts.append(", ".join(filler()) + "\n " + "  ".join(part).upper() + ". " + " ".join(filler()))
    return items, [*texts, "", " ", "!?", "of " * 5000]


def test_matches_equal_brute_force(spark):
    items, texts = cases()
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate([*texts, None])], "doc_id long, text string, item_id int")
    asked = spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string")
    got = d.matches(docs, asked).collect()
    want = {(j, i): n for j, t in enumerate(texts) for i, x in enumerate(items) if (n := brute(x, t)) is not None}
    assert {(r.doc_id, r.item_id): r.distance for r in got} == want and len(got) == len(want)
    assert want
    for r in got:
        part = d.normal(texts[r.doc_id]).split()[r.first_word : r.last_word + 1]
        assert brute(items[r.item_id], " ".join(part), rate=0.5) is not None
    kept = {r.doc_id for r in d.clean(docs, asked).collect()}
    assert kept == set(range(len(texts) + 1)) - {j for j, _ in want}
    assert d.clean(docs, asked).columns == docs.columns


def test_blocks_and_empty_tables(spark, monkeypatch):
    items, texts = cases()
    docs = spark.createDataFrame([*enumerate(texts[:50]), (0, texts[0]), (None, texts[0])], "doc_id long, text string")
    asked = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id long, text string")
    whole = sorted(map(str, d.matches(docs, asked).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 700)
    assert sorted(map(str, d.matches(docs, asked).collect())) == whole
    assert d.matches(docs.limit(0), asked).count() == 0
    assert d.matches(docs, asked.limit(0)).count() == 0
    assert d.clean(docs, asked.limit(0)).count() == docs.count()


def test_short_items_and_scripts_without_spaces(spark):
    docs = spark.createDataFrame([(1, "He said: read on, please."), (2, "He read it on"), (3, "前の文。短い文です。次"), (4, "短い文")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "Read on!"), (8, "短い文です"), (9, "read on"), (None, "read on"), (10, "!?")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in d.matches(docs, asked).collect()}
    assert got == {(1, 7, 0), (1, 9, 0), (1, None, 0), (3, 8, 0)}
    assert {r.doc_id for r in d.clean(docs, asked).collect()} == {2, 4}


def test_many_hits_in_one_text():
    item = "the old ship of the north came home again at night"
    finder = d.Finder([(1, item), (2, "the old ship of the south came home again by day")], d.ERROR_RATE, d.FEWEST)
    began = time.process_time()
    text = "the old ship of " * 60_000
    assert finder(text) == []
    assert [m[:2] for m in finder(text + item + " and " + text)] == [(1, 0)]
    assert time.process_time() - began < 20


def test_query(spark, tables):
    got = queries.op2_decontamination(spark, tables).collect()
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    items = spark.read.parquet(f"{tables}/benchmark.parquet").collect()
    exact = {(x.doc_id, i.item_id) for x in docs for i in items if d.normal(i.text) in d.normal(x.text)}
    assert exact <= {(r.doc_id, r.item_id) for r in got} and exact
