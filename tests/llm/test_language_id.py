"""The forward sum against all segmentations; held-out accuracy; odd rows."""

import math
import zlib

import numpy as np
import pytest

from lanternrank.llm import language_id as li
from lanternrank.llm import queries

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c"]


def brute(word, table, language):
    text = "▁" + word
    ids = {p: k for k, p in enumerate(PIECES)}

    def total(at):
        if at == len(text):
            return 1.0
        out = li.UNKNOWN * total(at + 1)
        for stop in range(at + 1, len(text) + 1):
            if text[at:stop] in ids:
                out += table[ids[text[at:stop]], language] * total(stop)
        return out

    return math.log(total(0))


def test_sum_over_segmentations():
    table = np.random.default_rng(1).dirichlet(np.ones(len(PIECES)), 2).T
    pieces = li.Pieces(PIECES)
    words = ["a", "ab", "abab", "cz", "zzz", "babab", "c", "aab"]
    got = li.log_likelihoods(pieces, table, words)
    want = [[brute(w, table, k) for k in range(2)] for w in words]
    np.testing.assert_allclose(got, want, rtol=1e-9)
    np.testing.assert_allclose(li._long(pieces, table, words), want, rtol=1e-9)


def test_long_words_are_whole():
    table = np.full((len(PIECES), 1), 1 / len(PIECES))
    pieces = li.Pieces(PIECES)
    for n in (li.LONGEST - 1, li.LONGEST, li.LONGEST + 1, 5000):
        got = li.log_likelihoods(pieces, table, ["ab" * n])[0, 0]
        assert got == pytest.approx(li._long(pieces, table, ["c", "ab" * n])[1, 0], rel=1e-9)
        assert np.isfinite(got)


def test_many_long_words_together(monkeypatch):
    monkeypatch.setattr(li, "LONG_CHARS", 500)
    table = np.random.default_rng(2).dirichlet(np.ones(len(PIECES)), 2).T
    pieces = li.Pieces(PIECES)
    words = ["ab" * n + "c" * (n % 3) for n in range(20, 60)] + ["a", "z" * 700]
    got = li.log_likelihoods(pieces, table, words)
    np.testing.assert_allclose(got, [li._long(pieces, table, [w])[0] for w in words], rtol=1e-9)


def test_letters_only():
    assert li.words_of("½ ² ① Ⅷ 12 _ !") == []
    assert li.words_of("x² a½b naïve Ⅷth 3rd") == ["x", "a", "b", "naïve", "th", "rd"]


def test_long_words_are_learned_from():
    pieces = li.Pieces(PIECES)
    p = li.learn(pieces, ["ab" * 200], np.array([3]))
    assert p[PIECES.index("aba")] + p[PIECES.index("ab")] > 0.5


def test_learning_raises_the_likelihood():
    pieces, words = li.Pieces(PIECES), ["abab", "aba", "cc"]
    counts = np.array([5, 3, 1])
    flat = np.full((len(PIECES), 1), 1 / len(PIECES))
    p = li.learn(pieces, words, counts)
    assert p.sum() == pytest.approx(1)
    fit = lambda t: counts @ li.log_likelihoods(pieces, t, words)[:, 0]
    assert fit(p[:, None]) > fit(flat)


ROWS = [
    (1, "the cat and the hat", "en"), (3, "le chat et la chatte", "fr"), (4, "the dog ran", "en"),
    (5, "la nuit est belle", "fr"), (6, None, "en"), (7, "", "en"), (8, "12 !!", "fr"),
    (9, "the cat " * 20_000, None), (9, "la chatte", None), (None, "the hat", "en"),
    (10, "THE CAT", None), (11, "x" * 20_000, None), (12, "½ ② Ⅷ", None),
]


def test_rows(spark):
    df = spark.createDataFrame([(*r, 1, "q") for r in ROWS], "doc_id long, text string, lang string, words int, lang_pred string")
    model = li.train(df, ["▁the", "▁la", "▁le", "▁", *"abcdefghijklmnopqrstuvwxyz"])
    assert model.languages == ["en", "fr"]
    got = li.identify(df, model).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, r.words): r for r in got}
    assert by[9, 40_000].lang_pred == "en" and by[9, 2].lang_pred == "fr"
    assert by[10, 2].lang_pred == "en" and by[None, 2].lang_pred == "en"
    assert [(by[k, 0].lang_pred, by[k, 0].score) for k in (6, 7, 8, 12)] == [("und", 0.0)] * 4
    assert all(0 <= r.score <= 1 for r in got)
    empty = li.train(df.limit(0), ["a"])
    assert empty.languages == [] and li.identify(df.limit(0), model).count() == 0
    assert {(r.lang_pred, r.score) for r in li.identify(df, empty).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark, tables):
    got = queries.op8_language_id(spark, tables).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert held and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
