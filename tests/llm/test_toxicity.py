"""Nearest examples against all cosines; held-out accuracy; odd rows."""

import random
from collections import Counter

import numpy as np

from lanternrank.llm import queries
from lanternrank.llm import toxicity as t


def test_nearest_is_exact():
    draw = random.Random(6)
    words = [f"w{k}" for k in range(120)]
    make = lambda: Counter(draw.choices(words[: draw.choice([20, 120])], k=draw.randrange(1, 30)))
    examples = [(k, k % 2, make()) for k in range(500)] + [(900 + k, 1, Counter()) for k in range(3)]
    index = t.Index(examples, {w: 0.1 + k % 7 for k, w in enumerate(words)}, 0.2)
    dense = np.zeros((len(index.ids), len(words)))
    by = {i: c for i, _, c in examples}
    for r, i in enumerate(index.ids):
        term, weight = index.vector(by[i])
        dense[r, term] = weight
    for _ in range(200):
        query = make()
        term, weight = index.vector(query)
        all_of = dense[:, term] @ weight
        places, cosines = index.nearest(query, 16)
        want = np.lexsort((np.arange(len(all_of)), -all_of.round(12)))[:16]
        assert places.tolist() == want[all_of[want] > 0].tolist()
        np.testing.assert_allclose(cosines, all_of[places], atol=1e-9)


def test_texts_together_find_the_same():
    draw = random.Random(8)
    words = [f"w{k}" for k in range(150)]
    make = lambda: Counter(draw.choices(words[draw.choice([0, 90]) :], k=draw.randrange(1, 30)))
    idf = {w: 0.1 + k % 7 for k, w in enumerate(words)}
    for n in (0, 5, 64, 70, 500):
        index = t.Index([(k, k % 2, make()) for k in range(n)], idf, 0.2)
        texts = [make() for _ in range(60)] + [Counter(), Counter({"unknown": 3})]
        for got, one in zip(index.nearest_of(texts), map(index.nearest, texts), strict=True):
            assert got[0].tolist() == one[0].tolist() and got[1].tolist() == one[1].tolist()


def test_texts_together_skip_blocks():
    examples = [(k, 0, Counter({f"a{k // 64}": 1, f"b{k}": 1})) for k in range(640)]
    index = t.Index(examples, {f"a{k}": 1.0 for k in range(10)} | {f"b{k}": 1.0 for k in range(640)}, 0.5)

    alone = index.nearest(Counter({"a3": 1}))[0].tolist()

    class Arrays(np.ndarray):
        opened = []

        def __getitem__(self, key):
            Arrays.opened.append(key[1].start // t.BLOCK)
            return np.asarray(self)[key]

    index.arrays = index.arrays.view(Arrays)
    (first, _), (second, _) = index.nearest_of([Counter({"a3": 1}), Counter({"a3": 2})])
    assert len(Arrays.opened) == 1 and first.tolist() == second.tolist() == alone


def test_ascii_words():
    text = "It's A_b C3d--Straße's end\tNEXT\x1fone\x00two 3.4e5 x"
    for x in (text, text.replace("ß", "ss")):
        assert t.stems(x) == Counter(w[: t.STEM] for w in t.WORDS.findall(x.lower()))


def test_blocks_are_skipped():
    examples = [(k, 0, Counter({f"a{k // 64}": 1, f"b{k}": 1})) for k in range(640)]
    index = t.Index(examples, {f"a{k}": 1.0 for k in range(10)} | {f"b{k}": 1.0 for k in range(640)}, 0.5)
    opened = []
    rough = index._rough
    index._rough = lambda term, weight, blocks: (opened.extend(blocks), rough(term, weight, blocks))[1]
    index.nearest(Counter({"a3": 1}))
    assert len(opened) < index.blocks


def test_frequencies(spark):
    rows = spark.createDataFrame([("aaa bbb aaa",), ("bbb",), (None,), ("",)] * 3, "text string").repartition(3)
    total, n = t.frequencies(rows, ["aaa", "bbb", "zzz"])
    assert total == 12 and n.tolist() == [3, 6, 0]


def test_rows(spark):
    texts = [(k, f"you awful clown number {k}" if k % 2 else f"what nice weather today {k}") for k in range(40)]
    docs = [*texts, (100, None), (101, ""), (102, "12 !!"), (None, "awful clown"), (1, texts[1][1]), (103, "clown " * 50_000)]
    df = spark.createDataFrame([(*d, 0.5, "e") for d in docs], "doc_id long, text string, score double, evidence string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(5, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    got = t.score(df, t.train(df, labels)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    empty = {by[k].score for k in (100, 101, 102)}
    assert len(empty) == 1 and by[100].evidence == []
    assert t.train(df.limit(0), labels).share == 0.0
    none = t.train(df, labels.limit(0))
    assert {r.score for r in t.score(df, none).collect()} == {0.0} and t.score(df.limit(0), none).count() == 0


def test_copies_keep_their_stems(spark):
    draw = random.Random(4)
    plain = [f"{a}{b}" for a in ("tree", "lake", "sky", "moss", "fern") for b in "abcdefgh"]
    rows = [(k, " ".join(draw.choices(plain, k=12))) for k in range(200)]
    rows += [(300 + k, "you idiot scum trash clown " + draw.choice(plain)) for k in range(20)]
    rows += [(400 + k, "you idiot scum trash clown") for k in range(110)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i, _ in rows], "doc_id long, toxic int")
    index = t.train(df, labels)
    seen = [c for i, _, c in ((i, 0, t.stems(x)) for i, x in rows) if i in set(index.ids)]
    assert set(index.terms) == {w for c in seen for w in c}
    got = {r.doc_id: r.predicted for r in t.score(df, index).collect()}
    assert got == {i: int(i >= 300) for i, _ in rows}


def test_held_out(spark, tables):
    tables = tables.replace("sf0.001", "sf0.1")
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, tables).collect()}
    labels = [r for r in spark.read.parquet(f"{tables}/labels.parquet").collect() if got[r.doc_id].held_out]
    hit = [got[r.doc_id].predicted for r in labels if r.toxic == 1]
    wrong = [got[r.doc_id].predicted for r in labels if r.toxic == 0]
    assert np.mean(hit) > 0.5 and np.mean(wrong) < 0.03, (np.mean(hit), np.mean(wrong))
