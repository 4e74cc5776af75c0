"""Places of rows inside their groups, without a task that holds a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, stored


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the row's place, from zero, among the rows of its ``group`` by ``order`` (nulls first, ties in any order).

    Rows are sorted by ranges of (group, order), so a group of any size is spread over as many partitions as it fills, equal rows
    included.  A place is the row's number inside its run, plus, for the one run of a partition that goes on from an
    earlier partition, the rows before it; those numbers are the only thing broadcast, at most one row for each partition."""
    spark = df.sparkSession
    ship(spark)
    tie, part = fresh(df, "_tie"), fresh(df, "_part")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*group, *order, tie]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop(tie)
    schema = T.StructType([*dealt.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(name, T.LongType())])

    def number(batches):
        here, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in group))) if group else [()] * b.num_rows
            at = np.empty(len(keys), np.int64)
            for i, k in enumerate(keys):
                seen = seen + 1 if k == last else 0
                last = k
                at[i] = seen
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(at), here, np.int32)), pa.array(at)], names=schema.names)

    rows = stored(dealt.mapInArrow(number, schema), "ranked")
    runs = rows.groupBy(part, *group).agg(F.count(F.lit(1)).alias("_run"))
    before = F.sum("_run").over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    going_on = runs.withColumn("_before", before).filter("_before > 0").select(
        F.col(part).alias("_at"), *(F.col(c).alias(f"_key{i}") for i, c in enumerate(group)), "_before")
    same = F.col(part) == F.col("_at")
    for i, c in enumerate(group):
        same &= rows[c].eqNullSafe(F.col(f"_key{i}"))
    out = rows.join(F.broadcast(going_on), same, "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
    return out.select(*df.columns, name)
