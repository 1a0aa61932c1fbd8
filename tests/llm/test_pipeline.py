"""The stages against a plain pipeline made of the brute-force versions."""

import re

import corpus_pipeline
import regex
import tiktoken
from test_decontaminate import brute as leak
from test_jaccard_join import brute as components
from test_line_dedup import brute as kept_lines

from lanternrank.llm import bpe


def make():
    filler = ["the sea and the ship are tall", "a hen ate of it in the ward", "all men sing of the old sea song"]
    item = "nobody knew what the seventh ship had carried over the dark northern sea"
    body = lambda k: "\n".join(f"{w} number{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} of the {'uvwxyz'[j]} tale " + " ".join(f"q{'abcdefghij'[(k * 7 + j * 3 + i) % 10]}{'abcdefghij'[(k * i + j) % 10]}{'klmnopqrst'[k // 10]}" for i in range(14)) for j, w in enumerate(["first", "second", "third"]))
    rows = [(k, body(k), "en", "s", 0) for k in range(30)]
    rows += [(50, body(3), "en", "s", 0), (51, f"{body(31)} {item} again", "en", "s", 0), (52, "12 !! 34", None, "s", 0)]
    rows += [(53, None, "en", None, None), (54, "", "en", "s", 0), (55, filler[0] + "\n" + body(32), "en", "s", 0)]
    rows += [(58, "½ ② Ⅷ", "en", "s", 0)]
    rows += [(56, filler[0].upper() + "\n" + body(33), "en", "s", 0), (57, " ".join(filler) + " x", None, "s", 0)]
    return rows, [(1, item)]


def plain(rows, items):
    docs = {i: t for i, t, *_ in rows if t and regex.search(r"\p{L}", t)}
    left = kept_lines(sorted(docs.items()))
    docs = {i: t for i, t in left.items() if t == docs[i] or re.search(r"\S", t)}
    docs = {i: docs[i] for i, _, c in components(sorted(docs.items()), 5, 80) if c == i}
    return {i: t for i, t in docs.items() if all(leak(x, t) is None for _, x in items)}


def test_stages(spark, tmp_path):
    rows, items = make()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        got.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    want = plain(rows, items)
    got = docs.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert {50, 51, 52, 53, 54, 58}.isdisjoint(want) and {55, 56, 57, *range(30)} <= set(want)
    assert all(r.n_chars == len(r.text) for r in got)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.ids for r in final} == {i: reference.encode_ordinary(t) for i, t in want.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in final)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
