"""Record files, the catalogue of data sets, and tables between steps."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternrank.sources.json_arrays import forms, objects, parsed

# Fields of the record files.
LAYOUTS = {
    "csn": (
        "url string, docstring_tokens array<string>, code_tokens array<string>, "
        "code_wo_comment string"
    ),
    "cosqa_query": "retrieval_idx string, doc string",
    "cosqa_code": "url string, code string, code_wo_comment string",
    "advtest": (
        "url string, docstring_tokens array<string>, function_tokens array<string>, "
        "function_wo_comment string"
    ),
    "code": "index string, label string, func string",
}

# Data sets, languages, and where their files lie.
CSN_LANGS = ("python", "java", "javascript", "php", "go", "ruby")
CODE_LANGS = ("python", "java", "javascript", "typescript", "csharp", "c", "ruby", "php", "go")
DATASETS = ("csn", "cosqa", "adv")
DISPLAY_ORDER = ("cosqa", "adv", "python", "java", "javascript", "php", "go", "ruby")
CSN_PATH = "CodeSearchNet/clean_data/dataset/{lang}/{split}.jsonl"
COSQA_QUERIES = "CoSQA/clean_data/cosqa-retrieval-{split}-500.json"
COSQA_CODE = "CoSQA/clean_data/code_idx_map_list_merged.json"
ADVTEST_PATH = "AdvTest/clean_data/dataset/{split}.jsonl"
CODE_PATH = "{lang}_with_func.jsonl"


@dataclass(frozen=True)
class Spec:
    """One collection to evaluate: its files, and how they are laid out."""

    dataset: str
    layout: str
    query_path: str
    passage_path: str
    query_schema: str
    passage_schema: str

    @property
    def same_file(self) -> bool:
        return self.query_path == self.passage_path


def _join(root: str, path: str) -> str:
    return f"{root.rstrip('/')}/{path}"


def catalogue(root: str, datasets: tuple[str, ...] = DATASETS, use_valid: bool = False) -> list[Spec]:
    """The collections of the named data sets below ``root``.

    ``use_valid`` takes validation queries; where one file is both sides, the
    passages change with it.
    """
    specs: list[Spec] = []
    for name in datasets:
        if name == "csn":
            split = "valid" if use_valid else "test"
            for lang in CSN_LANGS:
                queries = _join(root, CSN_PATH.format(lang=lang, split=split))
                code = _join(root, CSN_PATH.format(lang=lang, split="codebase"))
                specs.append(Spec(lang, "csn", queries, code, "csn", "csn"))
        elif name == "cosqa":
            queries = _join(root, COSQA_QUERIES.format(split="dev" if use_valid else "test"))
            code = _join(root, COSQA_CODE)
            specs.append(Spec("cosqa", "cosqa", queries, code, "cosqa_query", "cosqa_code"))
        elif name == "adv":
            both = _join(root, ADVTEST_PATH.format(split="valid" if use_valid else "test"))
            specs.append(Spec("adv", "advtest", both, both, "advtest", "advtest"))
        else:
            raise ValueError(f"unknown data set {name!r}, expected one of {DATASETS}")
    return specs


def read_records(spark: SparkSession, path: str, layout: str, array: bool | None = None) -> DataFrame:
    """Records with a declared schema: no pass over the data to infer one.

    Files hold one object per line or, if ``array``, one array of objects; both
    are split between tasks. By default ``.jsonl`` files hold lines, and each
    other file is looked at. Labels are read as text, quoted or not;
    ``collate_code`` casts them. Anything else than that form is an error, as is
    text after the array of a file, or a second object on a line; blank lines
    are passed over. Files of both forms may share a folder.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}, expected one of {sorted(LAYOUTS)}")
    schema = LAYOUTS[layout]
    if array is None:
        array = None if not path.endswith(".jsonl") else False
    if array is False:
        return parsed(lines_of(spark.read.text(path)), schema)
    arrays, lines = forms(spark, path)
    if array and lines:
        raise ValueError(f"text before the first array in {unquote(lines[0])}")
    parts = []
    if arrays:
        parts.append(parsed(objects(spark, [unquote(f) for f in arrays]), schema))
    if lines or not arrays:
        names = [unquote(f) for f in lines]
        # The names are as found, not patterns.
        text = spark.read.option("__globPaths__", "false").text(names) if names else spark.read.text(path)
        parts.append(parsed(lines_of(text), schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def lines_of(text: DataFrame) -> DataFrame:
    """``text`` of the lines that are not blank."""
    value = F.regexp_replace("value", "^\ufeff", "")
    return text.select(value.alias("text")).where(F.col("text").rlike(r"\S"))


def read_code(spark: SparkSession, directory: str, langs: tuple[str, ...] = CODE_LANGS) -> DataFrame:
    """Labelled code of several languages, with a ``lang`` column."""
    parts = [
        read_records(spark, _join(directory, CODE_PATH.format(lang=lang)), "code").withColumn(
            "lang", F.lit(lang)
        )
        for lang in langs
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def row_counts(**tables: DataFrame) -> DataFrame:
    """``name, n`` for each table."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in tables.items()
    ]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole


def with_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """Add a unique bigint per row, without a shuffle.

    Use it on a scan and write the result: ids repeat only as long as the
    partitions do.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def content_ids(df: DataFrame, *columns: str, name: str = "id") -> DataFrame:
    """Add a bigint that only depends on what a row holds: 60 bits of a digest
    of the columns, one per line. Equal rows share it."""
    text = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.withColumn(name, F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"))


def write_embeddings(
    df: DataFrame, path: str, partition_by: str | None = None, mode: str = "errorifexists"
) -> None:
    """Store vectors in single precision, so that ranking can be repeated."""
    stored = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    writer = stored.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Store a report as ``parquet`` or as tab-separated ``csv``."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        df.write.mode(mode).csv(path, header=True, sep="\t")
    else:
        raise ValueError(f"format must be parquet or csv, not {fmt!r}")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the session names."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage behind costly columns such as embeddings: later passes
    read columns from files, and lost executors do not repeat the model.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, over all cores.

    For costly per-row work on small files; a scan of many splits is left
    alone, so a large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
