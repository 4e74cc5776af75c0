"""Places of rows inside their groups by a distributed sort, without a task that holds a whole group.

Rows are sorted by ranges of (group, order), so a group of any size is spread over as many partitions as it fills, equal rows included.  A
place is the row's number in its partition, shifted by where the run starts and by the rows of its group in earlier partitions: one number
for each (partition, group), joined back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def places(df: DataFrame, group: str, order: str, name: str = "place") -> DataFrame:
    """``df`` with ``name``: the row's place, from zero, among the rows of its ``group`` by ``order`` (nulls first, ties in any order)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [group, order, "_tie"]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the number inside the partition
    path = scratch_path(spark, f"places-{uuid.uuid4().hex}")
    (df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_tie")
     .withColumns({"_part": F.spark_partition_id(), "_row": row}).write.parquet(path))
    rows = spark.read.parquet(path)
    runs = rows.groupBy("_part", group).agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_run"))
    before = F.coalesce(F.sum("_run").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (before - F.col("_start")).alias("_shift"))
    out = rows.join(starts, (F.col("_part") == F.col("_p")) & rows[group].eqNullSafe(F.col("_g")))
    return out.select(*df.columns, (F.col("_row") + F.col("_shift")).alias(name))
