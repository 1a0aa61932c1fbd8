"""Whole evaluations over small record files in the catalogue's places."""

import json
import random

import numpy as np
import pytest

import brute
from lanternrank.functions.hashing import HashingModel
from lanternrank.operators.embed import Encoder
from lanternrank.plans import suites
from lanternrank.sources import records as r
from lanternrank.streaming.embeddings import append_embeddings, read_record_stream

MODEL = Encoder("hashing-suite", HashingModel)
WORDS = [f"w{i}" for i in range(25)]


def write(path, rows, lines=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)) if lines else json.dumps(rows))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    rng = random.Random(5)
    words = lambda n: rng.choices(WORDS, k=n)
    base = tmp_path_factory.mktemp("data")
    for lang in r.CSN_LANGS:
        folder = base / f"CodeSearchNet/clean_data/dataset/{lang}"
        for name, n in (("test", 12), ("valid", 5), ("codebase", 30)):
            write(folder / f"{name}.jsonl", [
                {"url": f"u{i % 25}", "docstring_tokens": words(5), "code_tokens": words(9),
                 "code_wo_comment": " ".join(words(4))}
                for i in range(n)
            ])
    cosqa = base / "CoSQA/clean_data"
    for split in ("test", "dev"):
        write(cosqa / f"cosqa-retrieval-{split}-500.json",
              [{"retrieval_idx": i, "doc": " ".join(words(4))} for i in range(8)], lines=False)
    write(cosqa / "code_idx_map_list_merged.json",
          [{"url": i, "code": "\n".join(words(9)), "code_wo_comment": "x"} for i in range(20)], lines=False)
    for split in ("test", "valid"):
        write(base / f"AdvTest/clean_data/dataset/{split}.jsonl", [
            {"url": f"a{i}", "docstring_tokens": words(5), "function_tokens": words(9),
             "function_wo_comment": "x"} for i in range(15)
        ])
    code = base / "Code2Code"
    for lang in r.CODE_LANGS:
        write(code / f"{lang}_with_func.jsonl", [
            {"index": f"{i}", "label": i % 4, "func": f"x = '{' '.join(words(8))}'  " + ("# c" if lang in ("python", "ruby") else "// c")}
            for i in range(20)
        ])
    return base


def load(path):
    return [json.loads(x) for x in path.read_text().splitlines()]


def mrr(queries, q_keys, passages, p_keys):
    model = HashingModel()
    ids = np.arange(len(passages))
    ranks = brute.first_hits(model(queries, ""), q_keys, model(passages, ""), ids, p_keys)
    return np.mean([1 / x if x else 0 for x in ranks])


def test_text_suite(spark, root):
    report = suites.run_suite(spark, str(root), MODEL)
    found = {x.dataset: x for x in report.collect()}
    assert {k: v.queries for k, v in found.items()} == {
        **{lang: 12 for lang in r.CSN_LANGS}, "cosqa": 8, "adv": 15,
    }
    go = root / "CodeSearchNet/clean_data/dataset/go"
    asked, code = load(go / "test.jsonl"), load(go / "codebase.jsonl")
    want = mrr(
        [" ".join(x["docstring_tokens"]) for x in asked], [x["url"] for x in asked],
        [" ".join(x["code_tokens"]) for x in code], [x["url"] for x in code],
    )
    assert found["go"].mrr_at_1000 == pytest.approx(want, abs=0.02)  # ties go by row order
    shown = suites.show_suite(report).collect()
    assert [x.dataset for x in shown] == list(r.DISPLAY_ORDER)
    assert shown[4].mrr_at_1000 == round(found["javascript"].mrr_at_1000, 4)
    line = suites.display_line(suites.show_suite(report), "mrr_at_1000").first().line
    assert line.split("\t") == [str(x.mrr_at_1000) for x in shown]
    long = suites.long_report(report, "text", "dataset")
    assert long.count() == 8 * 11 and long.columns == ["suite", "dataset", "metric", "value"]


def test_part_of_the_suite_on_validation_splits(spark, root):
    report = suites.run_suite(spark, str(root), MODEL, ("csn", "adv"), use_valid=True, remain_format=True)
    assert {x.dataset: x.queries for x in report.collect()} == {
        **{lang: 5 for lang in r.CSN_LANGS}, "adv": 15,
    }


def test_code_suite(spark, root):
    scores = suites.run_code_suite(spark, str(root / "Code2Code"), MODEL)
    found = {x.lang: x.map for x in scores.collect()}
    assert set(found) == set(r.CODE_LANGS)
    shown = suites.show_code_suite(scores).collect()
    assert [x.lang for x in shown] == list(r.CODE_LANGS)
    rows = load(root / "Code2Code/java_with_func.jsonl")
    vectors = HashingModel()([x["func"].replace("// c", " ") for x in rows], "")
    ids = np.arange(len(rows))
    labels = [x["label"] for x in rows]
    aps = brute.average_precisions(vectors, ids, labels, vectors, ids, ids, labels)
    assert found["java"] == pytest.approx(np.mean(list(aps.values())), abs=0.02)


def test_cross_language(spark, root):
    from lanternrank.operators.collate import collate_code
    from lanternrank.operators.embed import embed

    code = r.with_ids(collate_code(r.read_code(spark, str(root / "Code2Code"), ("java", "c"))))
    vectors = r.materialize(embed(code, "func", MODEL), "cross")
    same = suites.cross_map(vectors, "java", "java").first().map
    other = suites.cross_map(vectors, "java", "c").first().map
    assert 0 < same <= 1 and 0 < other <= 1 and same != other


def test_stream_continues_where_it_stopped(spark, root, tmp_path):
    arrivals = tmp_path / "in"
    source = root / "AdvTest/clean_data/dataset/test.jsonl"
    write(arrivals / "1.jsonl", load(source)[:6])

    def run():
        records = read_record_stream(spark, str(arrivals), "advtest")
        query = append_embeddings(
            records, "advtest", MODEL, "query", str(tmp_path / "out"), str(tmp_path / "state")
        )
        query.awaitTermination()
        return r.read_embeddings(spark, str(tmp_path / "out"))

    assert run().count() == 6
    write(arrivals / "2.jsonl", load(source)[6:])
    rows = run().collect()
    assert sorted(x.key for x in rows) == sorted(f"a{i}" for i in range(15))
    first = next(x for x in rows if x.key == "a0")
    text = " ".join(load(source)[0]["docstring_tokens"])
    assert first.embedding == HashingModel()([text], "query")[0].tolist()


def test_one_file_for_both_sides_is_read_once(spark, root):
    asked, offered = suites.texts(spark, r.catalogue(str(root), ("adv",)))
    assert set(asked.inputFiles()) == set(offered.inputFiles())
    assert not any("AdvTest" in f for f in asked.inputFiles())
    assert asked.count() == offered.count() == 15


def test_ranks_do_not_depend_on_the_files(spark, root, tmp_path):
    """The same records in another order, and in several files."""
    other = tmp_path / "AdvTest/clean_data/dataset/test.jsonl"
    rows = load(root / "AdvTest/clean_data/dataset/test.jsonl")
    write(other / "a.jsonl", rows[::-2])
    write(other / "b.jsonl", rows[-2::-2])
    a, b = (suites.run_suite(spark, str(x), MODEL, ("adv",)).collect() for x in (root, tmp_path))
    assert a == b
