"""Collate and embed new record files, appending to an embedding table.

Both steps work row by row, so a stream needs no state and no watermark;
ranking then runs on the table as a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanternrank.operators.collate import collate
from lanternrank.operators.embed import Encoder, embed
from lanternrank.sources.json_arrays import parsed
from lanternrank.sources.records import LAYOUTS, lines_of


def read_record_stream(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    """JSON-lines records from files as they appear in a folder; a broken line,
    or one with two objects, stops the stream, as it stops a batch."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}, expected one of {sorted(LAYOUTS)}")
    return parsed(lines_of(spark.readStream.text(folder)), LAYOUTS[layout])


def append_embeddings(
    records: DataFrame,
    layout: str,
    model: Encoder,
    role: str,
    table: str,
    checkpoint: str,
    remain_format: bool = False,
) -> StreamingQuery:
    """Embed what has arrived and stop; run again to continue.

    Rows get their ids when the table is read, see ``with_ids``.
    """
    rows = collate(records, layout, remain_format).select(
        F.col("url").alias("key"), F.col(role).alias("text")
    )
    return (
        embed(rows, "text", model, role)
        .drop("text")
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
