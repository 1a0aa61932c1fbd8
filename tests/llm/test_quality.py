"""Counts and ratios against plain Python; odd rows."""

import math
import random
import re

import pytest
import xxhash

from lanternrank.llm import quality as q
from lanternrank.llm import queries

SPACE = re.compile("[\x20\x09-\x0d]+")


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def code(word):
    return xxhash.xxh64_intdigest(word.encode(), 42)


def grams(words):
    codes = [code(w.lower()) for w in words]
    pairs = [
        xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        for a, b in zip(codes, codes[1:], strict=False)
    ]
    return [signed(h) % q.BUCKETS for h in codes + pairs]


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def base(text):
    words, text = words_of(text), text or ""
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    repeated = {k + j for v in windows.values() if len(v) > 1 for k in v for j in range(8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(repeated),
    )


def texts():
    draw = random.Random(2)
    some = [" ".join(draw.choices("abc", k=draw.randrange(60))) for _ in range(60)]
    lines = ["\n".join(draw.choices(["x y", "x  y", " ", "", "# *|", "\x0bé　ß"], k=9)) for _ in range(40)]
    return [*some, *lines, None, "", " \t", "a " * 9000, "one two three four five six seven eight " * 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 0) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[0], (None, "a b", "y", 1)], "doc_id long, text string, kept string, bucket int")


def test_base_counts(docs):
    got = q.judge(docs, q.log_ratios(docs, docs.limit(0))).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(texts()):
        r = by[k]
        want = base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_ratios(docs):
    trusted = docs.where("doc_id in (1, 2, 3)").select("doc_id")
    ratios = {r.bucket: r.ratio for r in q.log_ratios(docs, trusted.union(trusted)).collect()}
    assert len(ratios) == q.BUCKETS
    every, rows = texts(), docs.collect()
    raw = [g for r in rows for g in grams(words_of(r.text))]
    target = [g for k in (1, 2, 3) for g in grams(words_of(every[k]))]
    for g in {*raw[:300], 5}:
        t = (target.count(g) + 1) / (len(target) + q.BUCKETS)
        r = (raw.count(g) + 1) / (len(raw) + q.BUCKETS)
        assert ratios[g] == pytest.approx(math.log(t) - math.log(r), abs=1e-5)
    got = {r.doc_id: r.log_ratio for r in q.judge(docs, q.log_ratios(docs, trusted)).collect()}
    g = grams(words_of(every[7]))
    assert got[7] == pytest.approx(sum(ratios[x] for x in g) / len(g), abs=1e-5)


def test_empty_table(spark, docs):
    none = docs.limit(0)
    ratios = q.log_ratios(none, none)
    assert q.judge(none, ratios).count() == 0
    assert {r.log_ratio for r in q.judge(docs, ratios).collect()} == {0.0}


def test_query_keeps_good_and_drops_bad(spark, tables):
    tables = tables.replace("sf0.001", "sf0.01")
    kept = {r.doc_id: r for r in queries.op9_quality(spark, tables).collect()}
    labels = spark.read.parquet(f"{tables}/labels.parquet").collect()
    good = [kept[r.doc_id] for r in labels if r.quality == 1]
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert all(r.kept or r.base_failed for r in good)
    assert sum(r.kept for r in bad) <= 0.25 * len(bad)
