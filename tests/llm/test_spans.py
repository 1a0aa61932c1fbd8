"""Word codes: one for each word, wherever it stands."""

import random

import pyarrow as pa

from lanternrank.llm import spans


def test_codes_depend_on_the_word_alone():
    draw = random.Random(3)
    pool = ["".join(draw.choices("abcé中x1", k=draw.randrange(1, 12))) for _ in range(5000)]
    pool += ["q" * n for n in (4095, 4096, 4097, 9000, 70_000, 200_000)]
    texts = [" ".join(draw.choices(pool, k=draw.randrange(300))) for _ in range(300)] + [None, "", "x"]
    texts += [" ".join(draw.choices(pool[-6:] + pool[:50], k=200)) for _ in range(4)]
    words = spans.words_of(pa.array(texts, pa.string()), spans.NOT_BLANK)
    code_of, word_of = {}, {}
    for start, end, code in zip(words.start, words.end, spans.word_codes(words).tolist()):
        word = words.data[start:end].tobytes()
        assert code_of.setdefault(word, code) == code and word_of.setdefault(code, word) == word
    assert len(code_of) > 3000


def test_sliced_arrays_and_bounds():
    whole = pa.array(["zz", "A b", None, "c  D", "", "e"])
    words = spans.words_of(whole.slice(1, 4), spans.NOT_BLANK)
    assert [words.data[a:b].tobytes() for a, b in zip(words.start, words.end)] == [b"a", b"b", b"c", b"d"]
    assert words.first.tolist() == [0, 2, 2, 4, 4]
    first, counts = spans.run_bounds(words, 2)
    assert first.tolist() == [0, 2] and counts.tolist() == [1, 0, 1, 0]
    assert len(spans.words_of(pa.array([], pa.string()), spans.ALNUM).start) == 0
