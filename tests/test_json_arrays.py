"""Arrays read in splits against the json module; what is no single array."""

import json
import random

import pytest

from lanternrank.sources import json_arrays as j
from lanternrank.sources import records as r

NASTY = ["", "}", "{", "][", '"', '\\"}', "\\", "\\\\", "a}b{c", "é中 ", "\n\t", "},{", '"},{"', "]]}}"]


def rows_of(draw, n):
    text = lambda: "".join(draw.choices([*NASTY, "word ", "x"], k=draw.randrange(8)))
    return [{"retrieval_idx": str(k), "doc": text(), "more": {"a": [text(), {"b": text()}], "c": {}}} for k in range(n)]


def written(draw, rows):
    style = draw.choice([{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": "\t"}])
    return draw.choice(["", "\n ", "﻿"]) + json.dumps(rows, **style) + draw.choice(["", "\n\n"])


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_arrays_in_small_splits(spark, tmp_path, small_splits, seed):
    draw = random.Random(seed)
    want = []
    for k in range(3):
        rows = rows_of(draw, 25 if k == 0 else draw.choice([0, 1, 25]))
        want += rows
        (tmp_path / f"f{k}.json").write_text(written(draw, rows), encoding="utf-8")
    assert j.pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    got = r.read_records(spark, str(tmp_path), "cosqa_query").collect()
    assert sorted((x.retrieval_idx, x.doc) for x in got) == sorted((x["retrieval_idx"], x["doc"]) for x in want)


def test_an_object_over_many_splits(spark, tmp_path, small_splits):
    rows = [{"retrieval_idx": "1", "doc": "} {" * 2000}, {"retrieval_idx": "2", "doc": "x" * 3000}, {"retrieval_idx": "3", "doc": ""}]
    (tmp_path / "long.json").write_text(json.dumps(rows))
    got = r.read_records(spark, str(tmp_path), "cosqa_query").collect()
    assert sorted((x.retrieval_idx, x.doc) for x in got) == [(x["retrieval_idx"], x["doc"]) for x in rows]


@pytest.mark.parametrize("text", [
    '[{"doc": "a"}] [{"doc": "b"}]', '[{"doc": "a"}]{"doc": "b"}', '[{"doc": "a"}] x', '[{"doc": "a"} {"doc": "b"}]',
    '[{"doc": "a"}', '[{"doc": "a}', '[{"doc": "a"}, ]', '[{"doc": "a"}, 3]', '["a"]', '[[{"doc": "a"}]]', '[{"doc": "a"}]]', "[", '[{"doc": "a"}}]',
    '[,{"doc": "a"}]', '[{"doc": "a"}, null]', '[{"doc": a}]',
])
def test_what_is_no_single_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception):
        r.read_records(spark, str(tmp_path / "f.json"), "cosqa_query").collect()


@pytest.mark.parametrize("line", [
    '{"doc": "b"}{"doc": "c"}', '{"doc": "b"} {"doc": "c"}', '{"doc": "b"}, {"doc": "c"}', '{"doc": "b"} x', '{"doc": "b"}]', "null", "3",
    '{"doc": "b"}] {"doc": "c"}', '{"doc": "b"}]} {"doc": "c"}', '[{"doc": "b"}]',
])
def test_a_line_is_one_object(spark, tmp_path, line):
    (tmp_path / "f.jsonl").write_text('{"doc": "a"}\n\n  \n' + line + "\n")
    with pytest.raises(Exception):
        r.read_records(spark, str(tmp_path / "f.jsonl"), "cosqa_query").collect()
    (tmp_path / "g.jsonl").write_text('﻿{"doc": "a}{"}\r\n\n {"doc": "[", "retrieval_idx": 7} \n')
    got = r.read_records(spark, str(tmp_path / "g.jsonl"), "cosqa_query").collect()
    assert sorted((x.doc, x.retrieval_idx) for x in got) == [("[", "7"), ("a}{", None)]


def test_an_empty_folder_file(spark, tmp_path):
    (tmp_path / "f.json").write_text("")
    assert r.read_records(spark, str(tmp_path / "f.json"), "cosqa_query").count() == 0
    (tmp_path / "g.json").write_text("[]")
    assert r.read_records(spark, str(tmp_path / "g.json"), "cosqa_query").count() == 0
