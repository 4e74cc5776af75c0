"""CSV scans with bad lines, and reports over many labels."""

import os
import uuid

from pyspark.sql import functions as F

from fraudscope.operators import metrics as M
from fraudscope.session import scratch_path
from fraudscope.sources.quarantine import scan_csv, split_csv

EXPECTED = {"step": "bigint", "type": "string", "amount": "double"}


def folder(spark, **files):
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    local = path.removeprefix("file://")
    os.makedirs(local)
    for name, text in files.items():
        with open(f"{local}/{name}.csv", "w") as f:
            f.write(text)
    return path


def test_good_and_bad_lines_add_up(spark):
    path = folder(spark, a="step,type,amount\n1,PAYMENT,2.5\n2,TRANSFER\n3,\"A, B\",7\n4,DEBIT,1,2\nx5,DEBIT,1e3\n6,,\n7,CASH_IN,NaN\n",
                  b="step,type,amount\n8,\"say \"\"hi\"\", you\",-1\nabc,DEBIT,def\n9,PAYMENT, 12 \n")
    good, bad = split_csv(spark, path, EXPECTED)
    assert sorted(tuple(r) for r in good.fillna(-99).select("step", F.coalesce("type", F.lit("-")), "amount").collect()) == [
        (1.0, "PAYMENT", 2.5), (3.0, "A, B", 7.0), (6.0, "-", -99.0), (7.0, "CASH_IN", -99.0), (8.0, 'say "hi", you', -1.0), (9.0, "PAYMENT", 12.0)]
    assert sorted(tuple(r) for r in bad.collect()) == [
        ("a.csv", "not_a_number:step", "x5,DEBIT,1e3"), ("a.csv", "too_few_fields:2", "2,TRANSFER"), ("a.csv", "too_many_fields:4", "4,DEBIT,1,2"),
        ("b.csv", "not_a_number:step,not_a_number:amount", "abc,DEBIT,def")]
    assert good.count() + bad.count() == scan_csv(spark, path, EXPECTED).count() == 10


def test_file_of_bad_lines_and_empty_file(spark):
    good, bad = split_csv(spark, folder(spark, only="step,type,amount\n1\n2,3,4,5\n"), EXPECTED)
    assert good.count() == 0 and [r["reason"] for r in bad.orderBy("line").collect()] == ["too_few_fields:1", "too_many_fields:4"]
    good, bad = split_csv(spark, folder(spark, none="step,type,amount\n"), EXPECTED)
    assert good.count() == 0 and bad.count() == 0


def test_reports_over_many_labels_need_no_grid(spark):
    """20,000 labels: a grid would have 400 million cells."""
    df = spark.range(40_000).select((F.col("id") % 20_000).alias("a"), F.when(F.col("id") % 4 == 0, F.col("id") % 20_000).otherwise((F.col("id") + 1) % 20_000).alias("p"))
    report = M.classification_report(df, "a", "p", digits=None)
    assert report.count() == 20_003
    accuracy = report.filter("label = 'accuracy'").first()
    assert accuracy["f1_score"] == 0.25 and accuracy["support"] == 40_000


def test_labels_that_meet_only_nulls_count_nothing(spark):
    df = spark.createDataFrame([("x", "x"), ("x", None), (None, "y"), ("z", "x")], "a string, p string")
    got = {r["label"]: (r["tp"], r["pred_n"], r["support"]) for r in M.per_class_counts(df, "a", "p").collect()}
    assert got == {"x": (1, 2, 1), "y": (0, 0, 0), "z": (0, 0, 1)}
