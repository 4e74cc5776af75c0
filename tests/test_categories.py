"""Places by a distributed sort, and categories as a stored table."""

import random
import uuid

from pyspark.sql import functions as F

from fraudscope.operators.categories import category_table, read_categories, sparse_vectors, store_categories, with_codes
from fraudscope.operators.features import FeaturePipeline
from fraudscope.operators.ranks import places
from fraudscope.session import scratch_path


def test_places_with_hot_groups_ties_and_nulls(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 1, 2, 2, 3, rng.randrange(1000)])) for _ in range(3000)]
    got = places(spark.createDataFrame(rows, "g string, v int").repartition(5), "g", "v").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["place"], r["v"]))
    assert sum(map(len, groups.values())) == 3000
    for g, found in groups.items():
        found.sort(key=lambda x: x[0])
        assert [p for p, _ in found] == list(range(len(found)))
        values = [v for _, v in found]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))
    assert places(spark.createDataFrame([], "g string, v int"), "g", "v").count() == 0


def stored(spark, df, columns):
    path = scratch_path(spark, f"cat-{uuid.uuid4().hex}")
    store_categories(category_table(df, columns), path)
    return read_categories(spark, path)


def test_very_many_values(spark):
    df = spark.range(120_000).select(F.concat(F.lit("v"), F.col("id")).alias("name"), (F.col("id") % 3).alias("few"))
    table = stored(spark, df, ["name", "few"])
    coded = with_codes(df, ["name", "few"], table)
    facts = coded.agg(F.countDistinct("name_code").alias("n"), F.max("name_code").alias("top"), F.max("few_code").alias("few"), F.count_if(F.col("name_code").isNull()).alias("none")).first()
    assert tuple(facts) == (120_000, 119_999, 2, 0)
    vectors = sparse_vectors(df.withColumn("x", F.lit(1.5)), ["x"], ["name", "few"], table)
    row = vectors.filter("name = 'v77'").first()["features_vec"]
    assert row.size == 1 + 120_000 + 3 and len(row.indices) == 3 and sorted(row.values.tolist()) == [1.0, 1.0, 1.5]


def test_vectors_equal_the_learned_one_hot(spark):
    rows = [(1.0, "b", "x"), (2.0, "a", None), (3.0, "c", "y"), (4.0, None, "x"), (5.0, "b", "zz")]
    df = spark.createDataFrame(rows, "num double, k string, m string")
    fitted = FeaturePipeline(["num"], ["k", "m"]).fit(df)
    fitted.state.means, fitted.state.stds = {"num": 0.0}, {"num": 1.0}
    want = {tuple(r["features"]) for r in fitted.transform(df, as_vector=False).collect()}
    got = sparse_vectors(df, ["num"], ["k", "m"], stored(spark, df, ["k", "m"]))
    assert {tuple(r["features_vec"].toArray()) for r in got.collect()} == want
    unseen = sparse_vectors(spark.createDataFrame([(9.0, "new", None)], df.schema), ["num"], ["k", "m"], stored(spark, df, ["k", "m"])).first()["features_vec"]
    assert unseen.toArray().tolist() == [9.0] + [0.0] * 6
