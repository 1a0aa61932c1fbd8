"""What a session needs before operators run: the package on workers, a shared folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import lanternrank


def prepare(spark: SparkSession) -> None:
    """Give workers the package, and local trials a folder for tables."""
    context = spark.sparkContext
    if not any("lanternrank" in Path(f).name for f in context.listFiles):
        root = Path(lanternrank.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="run-")) / "lanternrank.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(os.fspath(archive))
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the trial tables, in a session that is ready."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
