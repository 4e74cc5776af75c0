"""Paired streams, logs written exactly once, minute tables and what they leave out."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudscope.plans.queries_streams import _arriving, rule_credit, rule_fraud
from fraudscope.plans.scoring import credit_log_rows, fraud_log_rows, read_log, replace_log
from fraudscope.schemas import CREDIT_LOG_SCHEMA, FRAUD_LOG_SCHEMA
from fraudscope.session import scratch_path
from fraudscope.sources.tables import credit_requests, fraud_requests
from fraudscope.streaming.combined_stream import once, pair_scores
from fraudscope.streaming.monitor import LateRows, per_minute_stats, read_minute_table, start_minute_table
from fraudscope.streaming.tables import read_newest, read_table, start_table

SF = "/root/testdata/sf0.001"
HALF = "request_id string, timestamp timestamp, score double"


def place(spark):
    return scratch_path(spark, f"streams-{uuid.uuid4().hex}")


def rows_at(spark, values):
    return spark.createDataFrame([(i, s, x) for i, s, x in values], "request_id string, s long, score double").select("request_id", F.timestamp_seconds("s").alias("timestamp"), "score")


def arrive(spark, path, *files):
    """One micro-batch for each file."""
    for f in files:
        rows_at(spark, f).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(T.StructType.fromDDL(HALF)).option("maxFilesPerTrigger", 1).parquet(path)


def test_pairs_halves_and_bounds(spark):
    base = place(spark)
    fraud = arrive(spark, f"{base}/f", [("a", 1000, 0.1), ("b", 1000, 0.2), ("c", 1000, 0.3)], [("d", 5000, 0.4)], [("end", 90000, 0.0)], [("end2", 99000, 0.0)])
    credit = arrive(spark, f"{base}/c", [("a", 1500, 1.0), ("b", 1700, 2.0)], [("d", 4400, 3.0), ("e", 5000, 4.0)], [("end", 90000, 0.0)], [("end2", 99000, 0.0)])
    pairs = pair_scores(fraud, credit, within="10 minutes", late="5 minutes")
    query = start_table(pairs, f"{base}/out", f"{base}/state", available_now=True)
    query.awaitTermination()
    found = read_table(spark, f"{base}/out", pairs.schema).filter("request_id not like 'end%'")
    got = {(r["request_id"], r["status"]) for r in found.collect()}
    # b's halves are 700 seconds apart; c and e have no other half
    assert got == {("a", "complete"), ("b", "fraud_only"), ("b", "credit_only"), ("c", "fraud_only"), ("d", "complete"), ("e", "credit_only")}
    assert found.count() == 6
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 4  # the closing requests alone: older halves have left the state


def test_pairing_a_table_is_the_same_join(spark):
    f, c = rule_fraud(once(fraud_requests(spark, SF))), rule_credit(once(credit_requests(spark, SF)))
    out = pair_scores(f, c).groupBy("status").count().collect()
    n = {r["status"]: r["count"] for r in out}
    assert n["complete"] > 0 and n["complete"] + n["fraud_only"] == f.count() and n["complete"] + n["credit_only"] == c.count()


def test_second_delivery_in_a_later_batch_is_dropped_and_state_goes(spark):
    base = place(spark)
    stream = once(arrive(spark, f"{base}/in", [("a", 100, 1.0), ("b", 100, 1.0)], [("a", 160, 1.0), ("c", 200, 1.0)], [("z", 50000, 1.0)], [("y", 60000, 1.0)]), late="10 minutes")
    query = start_table(stream, f"{base}/out", f"{base}/state", available_now=True)
    query.awaitTermination()
    got = sorted(r["request_id"] for r in read_table(spark, f"{base}/out", stream.schema).collect())
    assert got == ["a", "b", "c", "y", "z"]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_repeated_jobs_replace_their_own_rows_only(spark):
    base = place(spark)
    for name, requests, score, rows, schema in (("fraud", fraud_requests, rule_fraud, fraud_log_rows, FRAUD_LOG_SCHEMA), ("credit", credit_requests, rule_credit, credit_log_rows, CREDIT_LOG_SCHEMA)):
        log = f"{base}/{name}"
        scored = rows(score(once(requests(spark, SF))), id_col="src_id")
        odd, even = scored.filter("id % 2 = 1"), scored.filter("id % 2 = 0")  # two jobs with rows on the same days
        for part, job in ((odd, "odd"), (even, "even"), (odd, "odd"), (even, "even")):
            replace_log(part, log, job)
        found = read_log(spark, log, schema)
        assert found.count() == scored.count() == found.select("request_id").distinct().count()
        assert found.drop("job").exceptAll(scored.select(*found.drop("job").columns)).count() == 0


def test_minutes_as_a_table_keyed_by_window(spark):
    base = place(spark)
    files = [[("a", 0, 1.0), ("b", 30, 0.0)], [("c", 59, 1.0), ("d", 60, 1.0)], [("e", 7200, 0.0)], [("g", 7205, 0.0)], [("late", 10, 1.0), ("f", 7210, 1.0)]]
    log = arrive(spark, f"{base}/in", *files).select("timestamp", (F.col("score") > 0).alias("is_fraud"), F.lit("v1").alias("model_version"))
    late = LateRows()
    spark.streams.addListener(late)
    try:
        query = start_minute_table(log, f"{base}/table", f"{base}/state", available_now=True)
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(late)
    got = {r["window_start"].timestamp(): (r["n_predictions"], r["fraud_rate"]) for r in read_minute_table(spark, f"{base}/table").collect()}
    assert got == {0.0: (3, 2 / 3), 60.0: (1, 1.0), 7200.0: (3, 1 / 3)}  # the late row is in no minute
    assert late.counts[str(query.runId)] == 1
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # minutes behind the watermark have left the state
    again = per_minute_stats(rows_at(spark, [r for f in files for r in f if r[0] != "late"]).select("timestamp", (F.col("score") > 0).alias("is_fraud"), F.lit("v1").alias("model_version")))
    assert {r["window_start"].timestamp(): (r["n_predictions"], r["fraud_rate"]) for r in again.collect()} == got


def test_newest_row_of_a_key(spark):
    base = place(spark)
    schema = T.StructType.fromDDL("k int, v int")
    for batch, rows in enumerate([[(1, 1), (2, 1)], [(2, 2)], [(2, 3), (3, 3)]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/t/batch_id={batch}")
    assert {tuple(r) for r in read_newest(spark, f"{base}/t", schema, ["k"]).collect()} == {(1, 1), (2, 3), (3, 3)}


def test_arriving_files_grow_with_the_session_and_the_last_comes_from_them(spark):
    base = scratch_path(spark, f"arriving-{uuid.uuid4().hex}")
    reads = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = spark.range(40000).select(F.col("id").alias("src_id"), F.col("id").cast("string").alias("request_id"), F.timestamp_seconds(F.col("id") * 60).alias("timestamp"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _arriving(spark, rows.mapInArrow(watch, rows.schema), base)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert reads.value <= 2 * 40000  # the ranges and the files; the last request is made from the files
    found = spark.read.parquet(base)
    assert found.filter("request_id <> 'end'").select(F.input_file_name()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 40001 and found.agg(F.max("timestamp")).first()[0] == found.filter("request_id = 'end'").first()["timestamp"]
