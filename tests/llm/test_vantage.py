"""Fingerprints, trees and groups against plain Python over all pairs; odd rows."""

import random
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lanternrank.llm import vantage
from lanternrank.llm.queries import op13_simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    codes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(c >> k & 1 for c in codes) > len(codes))


def components(rows, radius=4):
    codes = list({f for _, f in rows})
    root = {f: f for f in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(codes):
        for b in codes[:k]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            g = find(f)
            least[g] = min(i, least.get(g, i))
    return {f: least.get(find(f)) for f in codes}


def flips(draw, code, n):
    return reduce(lambda x, k: x ^ 1 << k, draw.sample(range(64), n), code)


def near_codes(draw, families, size):
    codes = set()
    for _ in range(families):
        code = draw.getrandbits(64)
        for _ in range(draw.randrange(1, size)):
            codes.add(code)
            code = flips(draw, code, draw.randrange(1, 7))
    return sorted(codes)


def test_fingerprints():
    draw = random.Random(1)
    words = ["sea", "Hen", "été", "中文", "x\x00y", "\x1c", "MO!"]
    texts = [None, "", " \n\t", "One", "One two", "one TWO three", "a b c d", "a\x0bb\x0cc\rd"]
    texts += [draw.choice([" ", "\n", "  "]).join(draw.choices(words, k=draw.randrange(200))) for _ in range(60)]
    texts += ["w " * 40_000, "long" * 30_000 + " b c d"]
    got = vantage.fingerprints_of(pa.array(texts, pa.string()))
    assert [int(x) for x in got] == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("leaf", [2, 7, 96])
def test_every_near_pair_shares_a_leaf(leaf):
    draw = random.Random(leaf)
    codes = np.array(near_codes(draw, 150, 12), np.uint64)
    leaves = []
    tree = vantage.grow(codes, leaf, leaves)
    assert sorted(np.concatenate([x.members for x in leaves]).tolist()) == list(range(len(codes)))
    together = set()
    for node, at, own in vantage.visits(tree, codes, 4, True):
        assert set(at[own]) == set(node.members)
        together |= {frozenset((int(a), int(b))) for a in at for b in node.members if a != b}
    near = {frozenset((i, j)) for i in range(len(codes)) for j in range(i) if (int(codes[i]) ^ int(codes[j])).bit_count() <= 4}
    assert near and near <= together


@pytest.mark.parametrize("shards, most", [(1, 1 << 20), (40, 1 << 20), (1, 16)])
def test_links_over_shards(spark, shards, most):
    draw = random.Random(9)
    codes = near_codes(draw, 120, 12) + near_codes(draw, 1, 200)
    signed = [c - (1 << 64 if c >> 63 else 0) for c in codes]
    nodes = spark.createDataFrame([(c,) for c in signed], "node long").repartition(3)
    links = vantage.near_links(nodes, sample=50, shards=shards, most=most).collect()
    mask = (1 << 64) - 1
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(r.a & mask), find(r.b & mask)
        root[max(a, b)] = min(a, b)
    want = components([(k, c) for k, c in enumerate(sorted(codes))])
    by_code = dict(enumerate(sorted(codes)))
    assert {c: find(c) for c in codes} == {c: find(by_code[want[c]]) for c in codes}
    assert len({find(c) for c in codes}) == len(set(want.values())) < len(codes)


def test_query_equals_plain(spark, tmp_path):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(150):
        text = draw.choices(words, k=draw.randrange(1, 300))
        rows.append((2 * k + 10, " ".join(text)))
        if k % 3 == 0:
            text[draw.randrange(len(text))] = "other"
            rows.append((2 * k + 11, "  ".join(text).upper()))
    rows += [(1000 + k, rows[5][1]) for k in range(60)] + [(2000, None), (2001, ""), (2002, " ")]
    draw.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op13_simhash(spark, str(tmp_path)).collect()}
    codes = [(i, fingerprint(t)) for i, t in rows]
    least = components(codes)
    assert got == {i: (f"{c:016x}", least[c]) for i, c in codes}
    assert len({c for _, c in got.values()}) < len({f for f, _ in got.values()})


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (7, "A b c d e"), (7, "A b c d e"), (3, "A  b c d e"), (None, "only one without an id"), (9, None), (8, "")]
    df = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in rows], "doc_id long, text string, id int, node string, component_id int")
    got = vantage.groups(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    key = lambda r: str(r)
    want = [(i, f"{fingerprint(t):016x}", {None: 8, "": 8, "only one without an id": None}.get(t, 3)) for i, t in rows]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert vantage.groups(df.limit(0)).count() == 0
