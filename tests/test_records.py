import json

import pytest
from pyspark.sql import functions as F

from lanternrank.operators.collate import collate_code
from lanternrank.sources import records as r
from lanternrank.streaming.embeddings import read_record_stream


def test_catalogue():
    specs = {s.dataset: s for s in r.catalogue("/d/")}
    assert list(specs) == ["python", "java", "javascript", "php", "go", "ruby", "cosqa", "adv"]
    assert specs["go"].query_path == "/d/CodeSearchNet/clean_data/dataset/go/test.jsonl"
    assert specs["go"].passage_path == "/d/CodeSearchNet/clean_data/dataset/go/codebase.jsonl"
    assert specs["cosqa"].query_path == "/d/CoSQA/clean_data/cosqa-retrieval-test-500.json"
    assert specs["adv"].same_file and not specs["go"].same_file
    valid = {s.dataset: s for s in r.catalogue("/d", use_valid=True)}
    assert valid["go"].query_path.endswith("go/valid.jsonl")
    assert valid["go"].passage_path == specs["go"].passage_path
    assert valid["cosqa"].query_path.endswith("cosqa-retrieval-dev-500.json")
    assert valid["adv"].passage_path.endswith("valid.jsonl") and valid["adv"].same_file
    assert [s.dataset for s in r.catalogue("/d", ("adv",))] == ["adv"]
    with pytest.raises(ValueError):
        r.catalogue("/d", ("other",))


def test_json_lines_and_documents(spark, tmp_path):
    rows = [{"url": 1, "code": "a\nb", "code_wo_comment": "a"}, {"url": "x", "code": "c"}]
    lines, whole = tmp_path / "t.jsonl", tmp_path / "t.json"
    lines.write_text("\n".join(json.dumps(x) for x in rows))
    whole.write_text(json.dumps(rows, indent=1))
    want = [("1", "a\nb", "a"), ("x", "c", None)]
    for path in (lines, whole):
        df = r.read_records(spark, str(path), "cosqa_code")
        assert [tuple(x) for x in df.collect()] == want
    with pytest.raises(ValueError):
        r.read_records(spark, str(lines), "other")


def test_malformed_records_are_not_dropped(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"url": "a"}\n{"url": \n')
    with pytest.raises(Exception, match="MALFORMED"):
        r.read_records(spark, str(path), "csn").collect()


def test_code_of_several_languages(spark, tmp_path):
    for lang in ("c", "go"):
        (tmp_path / f"{lang}_with_func.jsonl").write_text(
            json.dumps({"index": "1", "label": 5, "func": lang})
        )
    found = r.read_code(spark, str(tmp_path), ("c", "go")).collect()
    assert sorted(tuple(x) for x in found) == [("1", "5", "c", "c"), ("1", "5", "go", "go")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "k", [0.1, 2.0])], "id bigint, key string, embedding array<double>")
    r.write_embeddings(df, str(tmp_path / "e"), partition_by="key")
    back = r.read_embeddings(spark, str(tmp_path / "e"))
    assert dict(back.dtypes)["embedding"] == "array<float>" and back.count() == 1
    with pytest.raises(Exception, match="exist"):
        r.write_embeddings(df, str(tmp_path / "e"))
    report = spark.createDataFrame([("a", 0.5)], "name string, value double")
    r.write_report(report, str(tmp_path / "c"), "csv")
    text = spark.read.csv(str(tmp_path / "c"), header=True, sep="\t").collect()
    assert [tuple(x) for x in text] == [("a", "0.5")]
    r.write_report(report, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == report.collect()
    with pytest.raises(ValueError):
        r.write_report(report, str(tmp_path / "x"), "xml")


def test_counts_ids_and_materialized_tables(spark):
    df = r.with_ids(spark.range(50).repartition(4).select(F.col("id").alias("n")))
    kept = r.materialize(df, "ids")
    assert kept.select("id").distinct().count() == 50
    assert kept.dtypes == df.dtypes and kept.collect() == kept.collect()
    assert {x.name: x.n for x in r.row_counts(a=df, b=df.limit(3)).collect()} == {"a": 50, "b": 3}


def test_spread_leaves_wide_scans_alone(spark):
    assert r.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 4
    wide = spark.range(10, numPartitions=9)
    assert r.spread(wide) is wide


def test_json_files_are_read_by_what_they_hold(spark, tmp_path):
    rows = [{"retrieval_idx": k, "doc": f"d{k}"} for k in range(5)]
    lines, whole = tmp_path / "lines.json", tmp_path / "whole.json"
    lines.write_text("\n\n" + "\n".join(json.dumps(x) for x in rows))
    whole.write_text("\n " + json.dumps(rows, indent=2))
    want = {(str(k), f"d{k}") for k in range(5)}
    for path in (lines, whole):
        assert {tuple(x) for x in r.read_records(spark, str(path), "cosqa_query").collect()} == want
    one = tmp_path / "one.json"
    one.write_text(json.dumps(rows[0], indent=2))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        r.read_records(spark, str(one), "cosqa_query").collect()


def test_labels_may_be_quoted(spark, tmp_path):
    path = tmp_path / "go_with_func.jsonl"
    path.write_text("\n".join(json.dumps({"index": "1", "label": x, "func": "f"}) for x in ("3", 4)))
    got = collate_code(r.read_code(spark, str(tmp_path), ("go",)))
    assert sorted(x.label for x in got.collect()) == [3, 4]


def test_a_broken_line_stops_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"url": "u"}\n{"url": ')
    stream = read_record_stream(spark, str(tmp_path / "in"), "csn").writeStream.format("parquet")
    stream = stream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    with pytest.raises(Exception):
        stream.trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(ValueError):
        read_record_stream(spark, str(tmp_path), "other")


def test_a_second_root_is_an_error(spark, tmp_path):
    array = '[{"retrieval_idx": "1", "doc": "a ] \\\" ["}]'
    for name, text in (("two.json", f"{array}\n{array}\n"), ("tail.json", f'{array}\n{{"retrieval_idx": "2"}}')):
        (tmp_path / name).write_text(text)
        for kind in (None, True):
            with pytest.raises(ValueError, match="after the first"):
                r.read_records(spark, str(tmp_path / name), "cosqa_query", kind)
    (tmp_path / "one.json").write_text(f"\n{array}\n\n")
    assert r.read_records(spark, str(tmp_path / "one.json"), "cosqa_query").count() == 1


def test_a_folder_of_both_forms(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    rows = [{"retrieval_idx": str(k), "doc": f"d{k}"} for k in range(5)]
    (folder / "a.json").write_text(json.dumps(rows[:2], indent=1))
    (folder / "b.json").write_text("\n" + "\n".join(json.dumps(x) for x in rows[2:]))
    got = r.read_records(spark, str(folder), "cosqa_query").collect()
    assert sorted(tuple(x) for x in got) == [(str(k), f"d{k}") for k in range(5)]
