"""End-to-end jobs: CSV cleaning pipeline, German raw scan + tiering, credit + combined scoring."""

import uuid

from pyspark.sql import functions as F

from fraudscope.session import scratch_path
from fraudscope.sources.tables import raw_applicants, raw_transactions

SF = "/root/testdata/sf0.001"


def test_cleaning_pipeline_from_csv(spark):
    from fraudscope.plans.cleaning import run_cleaning_pipeline
    from fraudscope.sources.io import write_table
    import __spark_entry__ as E

    base = scratch_path(spark, f"clean-{uuid.uuid4().hex}")
    write_table(raw_transactions(spark, SF), f"{base}/fraud.csv", fmt="csv")
    write_table(raw_applicants(spark, SF), f"{base}/credit.csv", fmt="csv")
    fraud, credit = run_cleaning_pipeline(spark, f"{base}/fraud.csv", f"{base}/credit.csv", f"{base}/out")
    direct = E.queries()["clean_fraud"](spark, SF)
    cols = sorted(direct.columns)
    assert sorted(tuple(r) for r in fraud.select(cols).collect()) == sorted(tuple(r) for r in direct.select(cols).collect())
    assert credit.count() == E.queries()["clean_credit"](spark, SF).count()


def test_german_headerless_scan_and_tiering(spark):
    from fraudscope.functions.expressions import german_tier
    from fraudscope.operators.quantiles import exact_quantiles
    from fraudscope.sources.io import load_german_raw

    base = scratch_path(spark, f"german-{uuid.uuid4().hex}")
    lines = []
    for i in range(20):
        risk = 2 if i % 3 == 0 else 1
        lines.append(f"A11 {6 + i} A32 A43 {1000 + 250 * i} A61 A73 4 A93 A101 4 A121 {20 + i} A143 A152 2 A173 1 "
                     f"A192 A201 {risk}")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(base)
    df = load_german_raw(spark, base)
    assert df.count() == 20 and len(df.columns) == 21
    med = exact_quantiles(df, {"credit_amount": [0.5]}, where=F.col("credit_risk") == 2)[("credit_amount", 0.5)]
    assert med == 3250.0  # bad rows i = 0, 3, ..., 18: the middle of 7 amounts is i = 9
    tiers = {r["credit_amount"]: r["t"] for r in df.select("credit_amount", german_tier(bad_median=med).alias("t")).collect()}
    assert tiers[1000.0] == 1 and tiers[1000.0 + 250 * 18] == 2 and tiers[1250.0] == 0


def test_credit_model_and_combined_scoring(spark):
    from fraudscope.operators.clean import clean_credit_data, clean_fraud_data
    from fraudscope.operators.scoring import assign_request_ids
    from fraudscope.plans.scoring import Scorer, credit_log_rows, score_combined, score_credit
    from fraudscope.plans.training import (prepare_credit_data, prepare_fraud_data, save_trained,
                                           train_credit_model, train_fraud_model)
    from fraudscope.functions.names import standardise_column_names

    base = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    cprep = prepare_credit_data(clean_credit_data(raw_applicants(spark, SF)))
    counts = {r["label"]: r["count"] for r in cprep.train.groupBy("label").count().collect()}
    assert len(set(counts.values())) == 1 and set(counts) == {0, 1, 2}  # all three classes kept, balanced
    assert abs(cprep.test.count() - 0.2 * (cprep.test.count() + cprep.reference.count())) <= 5
    widths = {len(r["features"]) for r in cprep.train.limit(5).collect() + cprep.test.limit(5).collect()}
    assert widths == {len(cprep.features.feature_names())}  # same width on train and test
    ct = train_credit_model(cprep, numTrees=5, maxDepth=5)
    assert ct.metrics.count() == 1 and ct.extra["importances"].count() == len(cprep.features.feature_names())
    save_trained(ct, f"{base}/credit")
    ft = train_fraud_model(prepare_fraud_data(clean_fraud_data(raw_transactions(spark, SF)), resample="none"), maxIter=2)
    save_trained(ft, f"{base}/fraud")
    credit = Scorer.load(spark, f"{base}/credit")
    fraud = Scorer.load(spark, f"{base}/fraud")
    apps = assign_request_ids(clean_credit_data(raw_applicants(spark, SF)).drop("credit_risk")
                              .withColumn("rid", F.monotonically_increasing_id()), ["rid"]).limit(20).cache()
    scored = score_credit(credit, apps, keep=list(apps.columns)).collect()
    assert all(r["credit_tier"] in ("Good", "Moderate", "Poor") for r in scored)
    assert all(abs(r["confidence_good"] + r["confidence_moderate"] + r["confidence_poor"] - 1) < 0.01 for r in scored)
    log = credit_log_rows(score_credit(credit, apps, keep=list(apps.columns)))
    assert log.count() == 20 and "credit_tier" in log.columns
    tx_rows = standardise_column_names(raw_transactions(spark, SF)).drop("is_fraud", "name_orig", "name_dest") \
        .na.drop().limit(20).collect()
    app_rows = apps.drop("request_id", "rid").collect()
    tx = spark.createDataFrame([(f"r{i}", *r) for i, r in enumerate(tx_rows)],
                               "request_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in
                                                                 raw_transactions(spark, SF).select(
                                                                     "step", "type", "amount", "oldbalanceOrg",
                                                                     "newbalanceOrig", "oldbalanceDest",
                                                                     "newbalanceDest").schema.fields))
    tx = standardise_column_names(tx)
    ap = spark.createDataFrame([(f"r{i}", *r) for i, r in enumerate(app_rows)],
                               "request_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}"
                                                                 for f in apps.drop("request_id", "rid").schema.fields))
    from fraudscope.streaming.scoring_stream import credit_scoring_batch

    run = credit_scoring_batch(credit, f"{base}/clog", f"{base}/crej", key=["request_id"])
    run(ap, 7)
    run(ap, 7)  # replay: same folder overwritten
    assert spark.read.parquet(f"{base}/clog").count() == 20
    both = score_combined(fraud, credit, tx, ap).collect()
    assert len(both) == 20
    assert all(0 <= r["fraud"]["fraud_probability"] <= 1 and r["credit"]["credit_tier"] in ("Good", "Moderate", "Poor")
               for r in both)
