"""CRC by position tables against zlib; weights, scores and ranks against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternrank.llm import crc, importance
from lanternrank.llm.queries import op11_importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target):
    counts = []
    for texts in ([t for _, t in docs], target):
        n = [0] * 10_000
        for t in texts:
            for b in features(t)[1]:
                n[b] += 1
        counts.append(n)
    s, t = counts
    big_s, big_t = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000) / ((s[b] + 1.0) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, words, len(found), weight, score))
    able = sorted((r for r in rows if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    return rows, [r[0] for r in able[: 5 * len(able) // 100]]


def make(n=300, seed=5):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("sea", "Hen", "été", "中文", "x1", "MO") for b in ("ing", "ed", "", "7", "ward")]
    docs = [(k, draw.choice([" ", "\n", ", ", "_", "\x00"]).join(draw.choices(words, k=draw.randrange(60)))) for k in range(n)]
    return docs, [" ".join(draw.choices(words[:8], k=30)) for _ in range(10)]


@pytest.mark.parametrize("reach", [1, 2, 8, 64, 127, 128, 129, 255, 256, 257, 1000, 70_001])
def test_crc_of_spans(reach):
    draw = random.Random(reach)
    data = np.frombuffer(draw.randbytes(reach + 300), np.uint8)
    starts = np.array([0, 1, 7, 50, 300 - 1])
    ends = starts + np.array([reach, reach, 1, max(1, reach - 3), reach])
    got = crc.crc_of_spans(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_buckets_of_runs():
    texts = [None, "", " ", "One", "a,b", "x" * 127 + " y", "x" * 128 + " y " + "z" * 400, "中文" * 3000 + " tail"]
    texts += [t for _, t in make(50)[0]]
    found, words = importance._buckets(pa.array(texts, pa.string()), 3, 10_000)
    sizes = importance._features(words, 3)
    ends = np.cumsum(sizes)
    for text, n, size, end in zip(texts, words, sizes, ends):
        want_n, want = features(text)
        assert (n, size) == (want_n, len(want))
        assert sorted(found[end - size : end].tolist()) == sorted(want)


def test_query_equals_plain(spark, tmp_path):
    docs, target = make()
    docs += [(900, "Ab " * 40), (901, "ab " * 40), (902, None), (903, ""), (904, "q" * 50_000 + " r" * 25)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(enumerate(target), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in op11_importance(spark, str(tmp_path)).collect()}
    rows, drawn = brute(docs, target)
    assert {i: (r.n_features, r.weight, r.score) for i, r in got.items()} == {r[0]: (r[2], r[3], r[4]) for r in rows}
    assert [r.doc_id for r in sorted((r for r in got.values() if r.rank), key=lambda r: r.rank)] == drawn
    assert sorted(r.rank for r in got.values() if r.rank) == list(range(1, len(drawn) + 1)) and len(drawn) > 5


def test_odd_rows(spark):
    docs, target = make(120)
    twice = "a b c d e " * 5
    rows = [*docs, (500, twice), (500, twice), (500, twice), (None, twice), (None, None), (501, None)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, weight int, rank int, bucket int")
    goal = spark.createDataFrame([(t, 0) for t in target], "text string, n int")
    weighed = importance.weigh(df, importance.gains(df, goal))
    assert weighed.columns == ["doc_id", "text", "rank", "bucket", "n_words", "n_features", "weight"]
    got = importance.draw(weighed, percent=100).collect()
    plain, _ = brute(rows, target)
    key = lambda r: tuple(-1e18 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(((i, n, w, s) for i, _, n, w, s in plain), key=key)
    able = [r for r in plain if r[1] >= 20 and r[0] is not None]
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(able) + 1))
    assert [r.rank for r in got if r.doc_id in (None, 501)] == [None] * 3
    drawn = importance.resample(df, goal)
    assert drawn.columns == df.columns
    _, first = brute(rows, target)
    assert {r.doc_id for r in drawn.collect()} == set(first)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    row = importance.draw(importance.weigh(some, importance.gains(some, none)), percent=100).first()
    assert row.rank == 1 and row.n_features == 30 + 29 + 28


def test_many_equal_scores_are_cut(spark):
    rows = spark.range(4000).select(F.lit(1).alias("x"))
    got = importance.numbered(importance.part_files(rows, "equal"), [F.asc("x")])
    assert sorted(r.position for r in got.collect()) == list(range(1, 4001))
