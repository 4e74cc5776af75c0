"""Column profiles: one mergeable table of value counts for all columns, from which distributions, quality figures and drift are read.

``value_profile`` scans a table once and counts every value of every column (partial aggregation first, so a value that holds a third of the
rows is one row of each task).  Profiles of parts of a table add up to the profile of the table, are stored beside a model
at training time, and stand for the table afterwards: a drift run reads the stored profile and the new rows, never the training data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .drift import DEFAULT_RULE, DRIFT_SCHEMA, DriftRule, categorical_count_stats, is_numeric, numeric_count_stats, report_rows
from .prefix import cumulative

PROFILE_SCHEMA = "col string, kind string, num double, text string, n long"


def value_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``col, kind (num or cat), num, text, n``: the rows of each value.  Missing values (null, NaN) have neither ``num`` nor ``text``."""
    columns = columns or df.columns
    types = dict(df.dtypes)

    def cell(c: str):
        if is_numeric(types[c]):
            x = F.col(c).cast("double")
            return F.struct(F.lit(c).alias("col"), F.lit("num").alias("kind"), F.when(~F.isnan(x), x).alias("num"), F.lit(None).cast("string").alias("text"))
        return F.struct(F.lit(c).alias("col"), F.lit("cat").alias("kind"), F.lit(None).cast("double").alias("num"), F.col(c).cast("string").alias("text"))

    cells = df.select(F.explode(F.array(*[cell(c) for c in columns])).alias("e")).select("e.*")
    return merge_profiles(cells.withColumn("n", F.lit(1).cast("long")))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of all rows together."""
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out.groupBy("col", "kind", "num", "text").agg(F.sum("n").alias("n"))


def store_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).parquet(path)


def present(profile: DataFrame, kind: str) -> DataFrame:
    """``col, v, n`` of the values that are there."""
    v = "num" if kind == "num" else "text"
    return profile.filter((F.col("kind") == kind) & F.col(v).isNotNull()).select("col", F.col(v).alias("v"), "n")


def quality_figures(profile: DataFrame, digits: int = 6) -> DataFrame:
    """Per column: type, count, missing, distinct values, most common value, mean, std (sample), min, max, quartiles (exact, interpolated)."""
    there = F.col("num").isNotNull() | F.col("text").isNotNull()
    as_text = F.coalesce("text", F.col("num").cast("string"))
    base = profile.groupBy("col", "kind").agg(
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("missing"), F.count_if(there).alias("n_unique"),
        F.min_by(as_text, F.when(there, F.struct(-F.col("n"), as_text))).alias("most_common"),
        (F.sum(F.col("num") * F.col("n")) / F.sum(F.when(F.col("num").isNotNull(), F.col("n")))).alias("mean"), F.min("num").alias("min"), F.max("num").alias("max"))
    nums = present(profile, "num")
    means = base.select(F.col("col").alias("_col"), F.col("mean").alias("_m"), F.col("count").alias("_n"))  # one row a column
    centred = nums.join(F.broadcast(means), F.col("col") == F.col("_col"))
    spread = centred.groupBy("col").agg(F.sqrt(F.sum(F.col("n") * (F.col("v") - F.col("_m")) ** 2) / F.nullif(F.max("_n") - 1, F.lit(0))).alias("std"))
    # the value at rank k of a column is the first whose running count exceeds k
    run = cumulative(nums, "v", ["n"], groups=["col"]).join(F.broadcast(means), F.col("col") == F.col("_col"))
    picks = []
    for p in (0.25, 0.5, 0.75):
        h = (F.col("_n") - 1) * F.lit(p)
        at = [F.min(F.when(F.col("cum_n") > rank, F.col("v"))) for rank in (F.floor(h), F.ceil(h))]
        d = F.max(h - F.floor(h))
        picks.append((at[0] * (1 - d) + at[1] * d).alias(f"p{int(p * 100)}"))
    quartiles = run.groupBy("col").agg(*picks)
    out = base.join(spread, "col", "left").join(quartiles, "col", "left")
    return out.select(F.col("col").alias("column_name"), F.col("kind").alias("column_type"), "count", "missing", "n_unique", "most_common",
                      *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "max", "p25", "p50", "p75")])


def histogram(profile: DataFrame, bins: int = 10) -> DataFrame:
    """``col, bin, low, high, n``: counts of the numeric columns in ``bins`` bins of equal width."""
    nums = present(profile, "num")
    ends = nums.groupBy("col").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = nums.join(ends, "col").groupBy("col", "lo", "hi", at.alias("bin")).agg(F.sum("n").alias("n"))
    return counted.select("col", "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def drift_from_profiles(reference: DataFrame, current: DataFrame, digits: int = 6, rule: DriftRule = DEFAULT_RULE) -> DataFrame:
    """The drift report of two profiles (``drift.DRIFT_SCHEMA``) for the columns they share; ``current`` may be the profile of a window of the log."""
    kinds = {r["col"]: r["kind"] for r in reference.select("col", "kind").distinct().collect()}  # one row a column
    shared = sorted(r["col"] for r in current.select("col").distinct().collect() if r["col"] in kinds)
    nums = [c for c in shared if kinds[c] == "num"]
    current = current.filter(F.col("col").isin(shared))
    reference = reference.filter(F.col("col").isin(shared))

    def counts(as_double: bool, cols: list[str]) -> DataFrame:
        # a column's kind is the reference's; what the window types otherwise is read as that
        v = F.coalesce("num", F.col("text").cast("double")) if as_double else F.coalesce("text", F.col("num").cast("string"))
        sides = [p.filter(F.col("col").isin(cols)).select(
                     "col", v.alias("v"), (F.col("n") if ref else F.lit(0)).cast("long").alias("r"), (F.lit(0) if ref else F.col("n")).cast("long").alias("c"))
                 for p, ref in ((reference, True), (current, False))]
        return sides[0].unionByName(sides[1]).filter(F.col("v").isNotNull()).groupBy("col", "v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))

    num_stats = {}
    if nums:
        # read by every statistic below: merged once and stored (a row for each value of a column)
        path = scratch_path(reference.sparkSession, f"counts-{uuid.uuid4().hex}")
        counts(True, nums).write.parquet(path)
        vc = reference.sparkSession.read.schema("col string, v double, r long, c long").parquet(path)
        total = vc.groupBy("col").agg(F.sum("r").alias("_n"), (F.sum(F.col("v") * F.col("r")) / F.sum("r")).alias("_m")).withColumnRenamed("col", "_col")
        var = vc.join(F.broadcast(total), F.col("col") == F.col("_col")).groupBy("col").agg(F.sqrt(F.sum(F.col("r") * (F.col("v") - F.col("_m")) ** 2) / F.max("_n")).alias("s"))
        num_stats = numeric_count_stats(vc, nums, {r["col"]: float(r["s"] or 0.0) for r in var.collect()})
    cats = [c for c in shared if c not in nums] + [c for c in nums if not rule.is_number(num_stats[c]["nu"])]
    cat_stats = categorical_count_stats(counts(False, cats), cats) if cats else {}
    return reference.sparkSession.createDataFrame(report_rows(shared, num_stats, cat_stats, digits, rule), DRIFT_SCHEMA)


# ----------------------------------------------------------------------------- correlations
def spearman(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """``column_a, column_b, spearman``: rank correlation of each pair of numeric columns over the rows that have both.

    Ranks are averages over equal values, taken from running counts of distinct values.  A pair is ranked over the rows that have both values:
    the values of a column are counted once, with one count for each other column's presence, so one scan serves all pairs.  The counts and
    the ranks are stored (one row a value); a second scan looks up the ranks of each row and adds up all pairs, and no row is multiplied."""
    spark = df.sparkSession
    schema = "column_a string, column_b string, spearman double"
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    if not pairs:
        return spark.createDataFrame([], schema)
    at = range(len(columns))
    rows = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    there = [F.col(f"x{i}").isNotNull() for i in at]
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("v")) for i in at])).alias("e"), *[there[j].alias(f"t{j}") for j in at])
    counts = cells.filter("e.v IS NOT NULL").groupBy("e.c", "e.v").agg(*[F.count_if(f"t{j}").alias(f"k{j}") for j in at])
    base = scratch_path(spark, f"ranks-{uuid.uuid4().hex}")
    counts.write.parquet(f"{base}/counts")
    run = cumulative(spark.read.parquet(f"{base}/counts"), "v", [f"k{j}" for j in at], groups=["c"])
    run.select("c", "v", *[(F.col(f"cum_k{j}") - (F.col(f"k{j}") - 1) / 2.0).alias(f"r{j}") for j in at]).write.partitionBy("c").parquet(f"{base}/ranks")
    found = {r["c"] for r in spark.read.parquet(f"{base}/counts").select("c").distinct().collect()}  # one row a column
    pairs = [p for p in pairs if set(p) <= found]
    if not pairs:
        return spark.createDataFrame([], schema)
    for i in sorted(found):
        ranks = spark.read.parquet(f"{base}/ranks/c={i}")  # its own size decides how it is joined
        rows = rows.join(ranks.select(F.col("v").alias(f"v{i}"), *[F.col(f"r{j}").alias(f"r{i}_{j}") for j in at if j != i]), F.col(f"x{i}") == F.col(f"v{i}"), "left")
    sums = []
    for i, j in pairs:
        x, y = F.col(f"r{i}_{j}"), F.col(f"r{j}_{i}")
        # a row without one of the two has no share; ranks of n rows have the mean (n + 1) / 2
        sums.append((F.count_if(there[i] & there[j]), *[F.sum(F.when(there[i] & there[j], v)) for v in (x * y, x * x, y * y)]))
    one = rows.agg(*[v.alias(f"{name}{k}") for k, vs in enumerate(sums) for name, v in zip(("n", "xy", "xx", "yy"), vs)])

    def figure(k: int):
        n, xy, xx, yy = (F.col(f"{name}{k}") for name in ("n", "xy", "xx", "yy"))
        mean = n * ((n + 1) / 2.0) * ((n + 1) / 2.0)
        rho = F.try_divide(xy - mean, F.sqrt((xx - mean) * (yy - mean)))
        i, j = pairs[k]
        return F.struct(F.lit(columns[i]).alias("column_a"), F.lit(columns[j]).alias("column_b"), F.round(rho, digits).alias("spearman"), n.alias("n"))

    out = one.select(F.explode(F.array(*[figure(k) for k in range(len(pairs))])).alias("e")).select("e.*")
    return out.filter("n > 0").drop("n")


def contingency(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_a, column_b, a, b, n``: the rows of each pair of categories, all pairs of columns in one pass; rows without one of both are left out."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    cells = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs])
    return df.select(F.explode(cells).alias("e")).select("e.*").filter("a IS NOT NULL AND b IS NOT NULL").groupBy("column_a", "column_b", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(table: DataFrame, digits: int = 6) -> DataFrame:
    """``column_a, column_b, cramers_v`` of a contingency table: ``sqrt(chi2 / (n min(rows - 1, columns - 1)))``; null where a column has one category.

    ``chi2 / n`` is ``sum(n_ab^2 / (n_a n_b)) - 1``, so empty cells need no row of their own."""
    pair = ["column_a", "column_b"]
    side = {c: table.groupBy(*pair, c).agg(F.sum("n").alias(f"n_{c}")) for c in ("a", "b")}
    joined = table.join(side["a"], [*pair, "a"]).join(side["b"], [*pair, "b"])
    phi2 = joined.groupBy(*pair).agg((F.sum(F.col("n").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))) - 1).alias("phi2"))
    kinds = side["a"].groupBy(*pair).agg(F.count(F.lit(1)).alias("ka")).join(side["b"].groupBy(*pair).agg(F.count(F.lit(1)).alias("kb")), pair)
    v = F.sqrt(F.try_divide(F.greatest("phi2", F.lit(0.0)), (F.least("ka", "kb") - 1).cast("double")))
    return phi2.join(kinds, pair).select(*pair, F.round(v, digits).alias("cramers_v"))
