"""Both saved models over requests of one id: as a batch join and as a stream."""

import uuid

import pytest
from pyspark.sql import functions as F

from fraudscope.operators.clean import clean_credit_data, clean_fraud_data
from fraudscope.operators.validation import split_valid, validate_credit, validate_fraud
from fraudscope.plans import training
from fraudscope.plans.queries_boost import full_applications
from fraudscope.plans.queries_streams import _arriving
from fraudscope.plans.scoring import Scorer, score_combined, score_credit, score_fraud
from fraudscope.session import scratch_path
from fraudscope.sources.tables import credit_requests, fraud_requests, raw_applicants, raw_transactions
from fraudscope.streaming.combined_stream import once, pair_scores
from fraudscope.streaming.tables import read_table, start_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scorers(spark):
    base = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    fraud = training.prepare_fraud_data(clean_fraud_data(raw_transactions(spark, SF)), resample="none")
    credit = training.prepare_credit_data(clean_credit_data(raw_applicants(spark, SF)), resample="none")
    training.save_trained(training.train_fraud_model(fraud, learner="second_order", version="f9", n_trees=8, max_depth=3), f"{base}/fraud")
    training.save_trained(training.train_credit_model(credit, version="c9", numTrees=5, maxDepth=4), f"{base}/credit")
    return Scorer.load(spark, f"{base}/fraud"), Scorer.load(spark, f"{base}/credit")


def test_batch_and_stream_agree(spark, scorers):
    fraud, credit = scorers
    base = scratch_path(spark, f"combined-{uuid.uuid4().hex}")
    f, _ = split_valid(validate_fraud(once(fraud_requests(spark, SF))))
    c, rejected = split_valid(validate_credit(full_applications(once(credit_requests(spark, SF)))))
    batch = score_combined(fraud, credit, f, c).checkpoint()
    assert batch.count() == f.join(c, "request_id").count() > 0
    keep = ["request_id", "timestamp"]
    fs, _ = split_valid(validate_fraud(once(_arriving(spark, fraud_requests(spark, SF), f"{base}/f"))))
    cs, _ = split_valid(validate_credit(full_applications(once(_arriving(spark, credit_requests(spark, SF), f"{base}/c")))))
    pairs = pair_scores(score_fraud(fraud, fs, keep=keep), score_credit(credit, cs, keep=keep), within="1 hour", late=None)
    start_table(pairs, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    found = read_table(spark, f"{base}/out", pairs.schema).filter("request_id <> 'end' AND status = 'complete'")
    columns = ["request_id", "fraud.fraud_probability", "fraud.is_fraud", "fraud.model_version", "credit.credit_tier", F.col("credit.model_version").alias("cv")]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_values_of_the_combined_rows(spark, scorers):
    fraud, credit = scorers
    f, _ = split_valid(validate_fraud(once(fraud_requests(spark, SF))))
    c, _ = split_valid(validate_credit(full_applications(once(credit_requests(spark, SF)))))
    for r in score_combined(fraud, credit, f, c).collect():
        scores = r["credit"]["confidence_scores"]
        assert set(scores) == {"Good", "Moderate", "Poor"} and sum(scores.values()) == pytest.approx(1, abs=2e-4)
        assert scores[r["credit"]["credit_tier"]] == max(scores.values())
        assert 0 <= r["fraud"]["fraud_probability"] <= 1 and r["fraud"]["model_version"] == "f9" and r["credit"]["model_version"] == "c9"
