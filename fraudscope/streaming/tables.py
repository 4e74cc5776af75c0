"""Stream sinks as tables: one folder for each micro-batch, written in overwrite mode.

A micro-batch that is run again after a failure replaces its own folder, so the table holds every batch once.  Readers see the folders as
partitions ``batch_id``; a table of changing keys (update mode) is read as the newest batch of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def start_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = False,
                rows: Callable[[DataFrame], DataFrame] | None = None):
    """Write ``stream`` (through ``rows``, if given) to the table at ``path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (rows(batch) if rows else batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    w = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of the table with their ``batch_id``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def read_newest(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest row of each key (partial aggregation, one row for each key and task before the shuffle)."""
    values = [f.name for f in schema.fields if f.name not in keys]
    newest = F.max_by(F.struct(*values), F.col("batch_id")).alias("v")
    return read_table(spark, path, schema).groupBy(*keys).agg(newest).select(*keys, *(F.col(f"v.{c}").alias(c) for c in values))
