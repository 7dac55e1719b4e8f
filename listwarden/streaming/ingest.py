"""Resumable shard ingest: each source file is processed once and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_new_shards(spark: SparkSession, folder: str, split: str, schema: StructType | str,
                      rows: Callable[[DataFrame, str], DataFrame], out: str, checkpoint: str,
                      files_per_trigger: int | None = None) -> StreamingQuery:
    """Process the shards the checkpoint has not seen, then stop.

    The file sink commits whole batches, so a run that died half-way leaves no duplicate behind.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{split}-*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (
        rows(reader.parquet(folder), split).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
