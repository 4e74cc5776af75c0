"""The stratified split keeps its counts where rows repeat, and ranks no raw rows of a repeated key."""

from pyspark.sql import functions as F

from fraudscope.operators import sampling
from fraudscope.operators.sampling import hash_thresholds, stratified_split


def frame(spark):
    """3,000 rows with three distinct keys in class 0, 100 rows of one key in class 1."""
    return spark.range(0, 3100).select("id", (F.col("id") >= 3000).cast("int").alias("y"), F.when(F.col("id") < 3000, F.col("id") % 3).otherwise(9).alias("k"))


def test_counts_are_exact_with_repeated_keys(spark):
    df = frame(spark)
    s = stratified_split(df, "y", ["k"], 0.2, 42, row_id="id")
    n = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert n == {(0, "test"): 600, (0, "train"): 2400, (1, "test"): 20, (1, "train"): 80}
    again = stratified_split(df.repartition(7), "y", ["k"], 0.2, 42, row_id="id")
    assert s.select("id", "split").exceptAll(again.select("id", "split")).count() == 0
    parts = s.groupBy("y", "k").agg(F.countDistinct("split").alias("n")).groupBy("y").agg(F.sum(F.col("n") - 1).alias("split")).collect()
    assert all(r["split"] <= 1 for r in parts)  # one group of a class at most is on both sides


def test_thresholds_say_what_fits(spark):
    t = hash_thresholds(frame(spark), "y", ["k"], 42, quotas={0: 1200, 1: 100})
    assert t.rest == {0: 200} and set(t.values) == {0, 1}  # a quota that ends with its group splits none


def test_windows_run_over_counts(spark, monkeypatch):
    """No row_number over raw rows: the running sums see a row for each distinct hash."""
    monkeypatch.setattr(sampling.F, "row_number", None)
    assert hash_thresholds(frame(spark), "y", ["k"], 42, fraction=0.2).rest == {0: 600, 1: 20}
