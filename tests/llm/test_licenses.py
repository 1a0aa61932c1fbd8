"""Matches against exact containment in every window; odd rows."""

import random

import numpy as np

from lanternrank.llm import licenses as l
from lanternrank.llm import queries

TEMPLATES = {
    "short": "all rights are", "five": "one two three four five", "nine": "a b c d e f g h i",
    "long": " ".join(f"t{k}" for k in range(40)), "empty": "!?",
}


def shingles(words, width):
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]


def brute(text, templates, share=l.CONTAINED, width=l.WIDTH):
    """Best containment in any window of the class, where it reaches the share."""
    words, out = l.words_of(text or ""), {}
    for name, t in templates.items():
        t = l.words_of(t)
        if not t:
            continue
        own = min(width, len(t))
        asked, size, every = set(shingles(t, own)), l.size_class(len(t)), shingles(words, own)
        for start in range(0, len(every), size):
            got = len(asked & set(every[start : start + 2 * size - own + 1])) / len(asked)
            if got >= share and got > out.get(name, 0):
                out[name] = got
    return out


def texts():
    draw, out = random.Random(4), []
    for _ in range(250):
        words = draw.choices("abcdefghixyz", k=draw.randrange(60))
        for name in draw.choices(sorted(TEMPLATES), k=draw.randrange(3)):
            part = TEMPLATES[name].split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                part[draw.randrange(len(part))] = "zz"
            at = draw.randrange(len(words) + 1)
            words[at:at] = part
        out.append(draw.choice([", ", " ", "\n"]).join(words))
    return out


def test_equal_to_exact_containment():
    got = {}
    for k, name, share, first, last in l.Scanner(TEMPLATES)(texts()):
        got[k, name] = share
        assert 0 <= first <= last < len(l.words_of(texts()[k]))
    want = {(k, n): s for k, t in enumerate(texts()) for n, s in brute(t, TEMPLATES).items()}
    assert set(got) <= set(want) and all(got[x] <= want[x] for x in got)
    missed = [x for x in want if x not in got]
    assert len(missed) <= 0.01 * len(want) and len(want) > 100


def test_bands_guarantee_the_probability():
    for text in l.TEMPLATES.values():
        assert l.least_probability(len(l.words_of(text))) > 0.99
    for n in range(1, 400):
        assert n <= l.size_class(n) <= max(3, 1.25 * n + 1)


def test_rows(spark):
    notice = l.TEMPLATES["GPL-3.0"]
    rows = [(1, notice.upper() + "."), (1, notice.upper() + "."), (2, None), (3, ""), (None, f"x {notice} y"),
            (4, "w " * 100_000 + notice), (5, "This work is licensed under nothing at all"), (6, "All rights reserved.")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license, r.containment, r.first_word, r.last_word) for r in l.scan(df).collect()), key=str)
    want = [(1, "GPL-3.0", 1.0, 0, 11)] * 2 + [(None, "GPL-3.0", 1.0, 1, 12), (4, "GPL-3.0", 1.0, 100_000, 100_011)]
    assert got == sorted([*want, (6, "all-rights-reserved", 1.0, 0, 2)], key=str)
    assert l.scan(df.limit(0)).count() == 0 and l.scan(df, {}).count() == 0


def test_query(spark, tables):
    got = {(r.doc_id, r.license) for r in queries.op1_licenses(spark, tables).collect()}
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    want = {(r.doc_id, n) for r in docs for n in brute(r.text, l.TEMPLATES)}
    assert got <= want and len(want - got) <= 0.01 * len(want) and np.all(len(got) > 0)
