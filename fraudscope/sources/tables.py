"""Driver tables and the deterministic views derived from them.

The driver's tables hold no transactions or loan applicants, so the same
arithmetic turns them into inputs shaped like the real ones:

* ``raw_transactions``  orders JOIN customer -> PaySim-style transactions (camelCase),
  with NULLs injected in amount / balance / type / label and a share of exact copies;
* ``raw_applicants``    customer -> German-credit-style applicants (codes A11..A174);
* ``german_applicants`` customer -> applicants with the raw good(1)/bad(2) label.

Each view exists twice: as a DataFrame (what the library runs) and as a SQL CTE
(what the DuckDB oracle runs).  Both read every row of their source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _copies(n_expr) -> F.Column:
    return F.explode(F.sequence(F.lit(1), n_expr))


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    j = o.join(cu, o["o_custkey"] == cu["c_custkey"], "inner")
    k = F.col("o_orderkey")
    pr = F.substring("o_orderpriority", 1, 1)
    price = F.col("o_totalprice")
    old_org = F.greatest(F.col("c_acctbal"), F.lit(0.0)) * F.lit(100.0)
    old_dest = (F.col("o_custkey") % 1000).cast("double") * F.lit(125.0)
    ttype = (
        F.when(pr == "1", "TRANSFER").when(pr == "2", "CASH_OUT").when(pr == "3", "PAYMENT")
        .when(pr == "4", "DEBIT").otherwise("CASH_IN")
    )
    out = j.select(
        (F.lit(1) + k % 743).cast("bigint").alias("step"),
        F.when(k % 97 == 5, F.lit(None).cast("string")).otherwise(ttype).alias("type"),
        F.when(k % 53 == 0, F.lit(None).cast("double")).otherwise(price).alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        F.when(k % 59 == 0, F.lit(None).cast("double")).otherwise(old_org).alias("oldbalanceOrg"),
        F.when(k % 7 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), old_org - price)).alias("newbalanceOrig"),
        F.concat(F.lit("M"), (k % 5000).cast("string")).alias("nameDest"),
        old_dest.alias("oldbalanceDest"),
        F.when(k % 9 == 0, old_dest).otherwise(old_dest + price).alias("newbalanceDest"),
        F.when(k % 101 == 0, F.lit(None))
        .when(pr.isin("1", "2") & (price > 250000) & (k % 3 != 0), F.lit(1))
        .otherwise(F.lit(0)).cast("bigint").alias("isFraud"),
        _copies(F.when(k % 41 == 0, F.lit(2)).otherwise(F.lit(1))).alias("_copy"),
    )
    return out.drop("_copy")


RAW_TRANSACTIONS_SQL = """
txn_base AS (
  SELECT CAST(1 + o_orderkey % 743 AS BIGINT) AS step,
    CASE WHEN o_orderkey % 97 = 5 THEN NULL
         WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'TRANSFER'
         WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'CASH_OUT'
         WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'PAYMENT'
         WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'DEBIT'
         ELSE 'CASH_IN' END AS type,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_totalprice END AS amount,
    'C' || CAST(o_custkey AS VARCHAR) AS nameOrig,
    CASE WHEN o_orderkey % 59 = 0 THEN NULL
         ELSE greatest(c_acctbal, CAST(0 AS DOUBLE)) * CAST(100 AS DOUBLE) END AS oldbalanceOrg,
    CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE)
         ELSE greatest(CAST(0 AS DOUBLE), greatest(c_acctbal, CAST(0 AS DOUBLE)) * CAST(100 AS DOUBLE) - o_totalprice) END
      AS newbalanceOrig,
    'M' || CAST(o_orderkey % 5000 AS VARCHAR) AS nameDest,
    CAST(o_custkey % 1000 AS DOUBLE) * CAST(125 AS DOUBLE) AS oldbalanceDest,
    CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey % 1000 AS DOUBLE) * CAST(125 AS DOUBLE)
         ELSE CAST(o_custkey % 1000 AS DOUBLE) * CAST(125 AS DOUBLE) + o_totalprice END AS newbalanceDest,
    CAST(CASE WHEN o_orderkey % 101 = 0 THEN NULL
         WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') AND o_totalprice > 250000 AND o_orderkey % 3 <> 0 THEN 1
         ELSE 0 END AS BIGINT) AS isFraud,
    unnest(generate_series(1, CASE WHEN o_orderkey % 41 = 0 THEN 2 ELSE 1 END)) AS _copy
  FROM orders JOIN customer ON o_custkey = c_custkey
),
txn AS (SELECT step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, oldbalanceDest,
               newbalanceDest, isFraud FROM txn_base)
"""


def raw_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    bal = F.col("c_acctbal")

    def code(prefix: str, expr):
        return F.concat(F.lit(prefix), expr.cast("string"))

    out = cu.select(
        F.when(k % 43 == 0, F.lit(None).cast("bigint")).otherwise(F.lit(15) + k % 60).cast("bigint").alias("age"),
        (F.lit(6) + (k * 7) % 67).cast("bigint").alias("duration_months"),
        F.when(k % 47 == 0, F.lit(None).cast("double")).otherwise(bal * F.lit(3.0)).alias("credit_amount"),
        (F.lit(1) + k % 4).cast("bigint").alias("installment_rate"),
        (F.lit(1) + (k * 3) % 4).cast("bigint").alias("residence_since"),
        (F.lit(1) + (k * 5) % 4).cast("bigint").alias("existing_credits"),
        (F.lit(1) + k % 2).cast("bigint").alias("num_dependents"),
        F.when(k % 31 == 0, F.lit(None).cast("string")).otherwise(code("A1", F.lit(1) + k % 4)).alias("checking_account"),
        code("A3", k % 5).alias("credit_history"),
        code("A4", k % 11).alias("purpose"),
        code("A6", F.lit(1) + k % 5).alias("savings"),
        code("A7", F.lit(1) + (k * 3) % 5).alias("employment"),
        code("A15", F.lit(1) + k % 3).alias("housing"),
        code("A17", F.lit(1) + (k * 7) % 4).alias("job"),
        F.when(k % 89 == 0, F.lit(None))
        .when(bal < 1000, F.lit(2)).when(bal < 4000, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("credit_risk"),
        _copies(F.when(k % 37 == 0, F.lit(2)).otherwise(F.lit(1))).alias("_copy"),
    )
    return out.drop("_copy")


RAW_APPLICANTS_SQL = """
app_base AS (
  SELECT CAST(CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE 15 + c_custkey % 60 END AS BIGINT) AS age,
    CAST(6 + (c_custkey * 7) % 67 AS BIGINT) AS duration_months,
    CASE WHEN c_custkey % 47 = 0 THEN NULL ELSE c_acctbal * CAST(3 AS DOUBLE) END AS credit_amount,
    CAST(1 + c_custkey % 4 AS BIGINT) AS installment_rate,
    CAST(1 + (c_custkey * 3) % 4 AS BIGINT) AS residence_since,
    CAST(1 + (c_custkey * 5) % 4 AS BIGINT) AS existing_credits,
    CAST(1 + c_custkey % 2 AS BIGINT) AS num_dependents,
    CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 'A1' || CAST(1 + c_custkey % 4 AS VARCHAR) END AS checking_account,
    'A3' || CAST(c_custkey % 5 AS VARCHAR) AS credit_history,
    'A4' || CAST(c_custkey % 11 AS VARCHAR) AS purpose,
    'A6' || CAST(1 + c_custkey % 5 AS VARCHAR) AS savings,
    'A7' || CAST(1 + (c_custkey * 3) % 5 AS VARCHAR) AS employment,
    'A15' || CAST(1 + c_custkey % 3 AS VARCHAR) AS housing,
    'A17' || CAST(1 + (c_custkey * 7) % 4 AS VARCHAR) AS job,
    CAST(CASE WHEN c_custkey % 89 = 0 THEN NULL WHEN c_acctbal < 1000 THEN 2 WHEN c_acctbal < 4000 THEN 1
         ELSE 0 END AS BIGINT) AS credit_risk,
    unnest(generate_series(1, CASE WHEN c_custkey % 37 = 0 THEN 2 ELSE 1 END)) AS _copy
  FROM customer
),
applicants AS (SELECT age, duration_months, credit_amount, installment_rate, residence_since, existing_credits,
                      num_dependents, checking_account, credit_history, purpose, savings, employment, housing, job,
                      credit_risk FROM app_base)
"""


def german_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw German-credit style rows: credit_risk 1 = good, 2 = bad."""
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    k = F.col("c_custkey")
    return cu.select(
        k.alias("applicant_id"),
        F.abs(F.col("c_acctbal")).alias("credit_amount"),
        (F.lit(6) + (k * 7) % 67).cast("bigint").alias("duration_months"),
        F.when((k + F.col("c_nationkey")) % 10 < 3, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("credit_risk"),
    )


GERMAN_APPLICANTS_SQL = """
german AS (
  SELECT c_custkey AS applicant_id, abs(c_acctbal) AS credit_amount,
         CAST(6 + (c_custkey * 7) % 67 AS BIGINT) AS duration_months,
         CAST(CASE WHEN (c_custkey + c_nationkey) % 10 < 3 THEN 2 ELSE 1 END AS BIGINT) AS credit_risk
  FROM customer
)
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(x.strip() for x in ctes)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary scored rows: y = labels.quality, p = n_chars / (n_chars + 5000) (a monotone score)."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars").cast("double")
    return lab.join(doc, "doc_id").select(
        "doc_id",
        F.col("quality").cast("int").alias("y"),
        F.col("toxic").cast("int").alias("y_toxic"),
        (n / (n + F.lit(5000.0))).alias("p"),
    )


SCORED_DOCUMENTS_SQL = """
scored AS (
  SELECT d.doc_id, CAST(l.quality AS INTEGER) AS y, CAST(l.toxic AS INTEGER) AS y_toxic,
         CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + CAST(5000 AS DOUBLE)) AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)
"""


def scored_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-class scored rows: actual from l_returnflag (A/N/R -> 0/1/2), rule probabilities, argmax prediction."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax"
    )
    s0 = F.col("l_quantity")
    s1 = F.col("l_discount") * F.lit(500.0)
    s2 = F.col("l_tax") * F.lit(625.0)
    tot = s0 + s1 + s2
    out = li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("actual"),
        (s0 / tot).alias("p0"), (s1 / tot).alias("p1"), (s2 / tot).alias("p2"),
    )
    return out.withColumn(
        "predicted",
        F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0)
        .when(F.col("p1") >= F.col("p2"), 1).otherwise(2),
    )


SCORED_LINEITEMS_SQL = """
li3 AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS actual,
         l_quantity / (l_quantity + l_discount * CAST(500 AS DOUBLE) + l_tax * CAST(625 AS DOUBLE)) AS p0,
         l_discount * CAST(500 AS DOUBLE) / (l_quantity + l_discount * CAST(500 AS DOUBLE) + l_tax * CAST(625 AS DOUBLE)) AS p1,
         l_tax * CAST(625 AS DOUBLE) / (l_quantity + l_discount * CAST(500 AS DOUBLE) + l_tax * CAST(625 AS DOUBLE)) AS p2
  FROM lineitem
),
scored3 AS (
  SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted FROM li3
)
"""


# FIXED VALUES: the applicants' employment and purpose texts by number
_EMPLOYMENT = ["unemployed", "< 1 year", "1-4 years", "4-7 years", ">= 7 years"]
_PURPOSE = ["car", "furniture", "radio/TV", "education", "business"]


def _pick(values: list[str], number: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def _orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    j = o.join(cu, o["o_custkey"] == cu["c_custkey"])
    # requests of thirty days from 2024-03-01 on
    return j.withColumn("second", F.lit(1709251200).cast("long") + F.col("o_orderkey") * 977 % 2592000)


def fraud_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests, one per order (every eleventh order has none; every 41st is delivered twice), with a rule's probability ``p``."""
    j = _orders_with_customers(spark, sf_dir).filter("o_orderkey % 11 <> 0")
    k, price, pr = F.col("o_orderkey"), F.col("o_totalprice"), F.substring("o_orderpriority", 1, 1)
    old = F.greatest(F.col("c_acctbal"), F.lit(0.0)) * F.lit(100.0)
    dest = (F.col("o_custkey") % 1000).cast("double") * F.lit(125.0)
    kind = F.when(pr == "1", "TRANSFER").when(pr == "2", "CASH_OUT").when(pr == "3", "PAYMENT").when(pr == "4", "DEBIT").otherwise("CASH_IN")
    return j.select(
        k.alias("src_id"), k.cast("string").alias("request_id"), F.timestamp_seconds("second").alias("timestamp"), (F.lit(1) + k % 743).cast("int").alias("step"),
        kind.alias("type"), price.alias("amount"), old.alias("oldbalance_org"), F.greatest(F.lit(0.0), old - price).alias("newbalance_orig"),
        dest.alias("oldbalance_dest"), (dest + price).alias("newbalance_dest"), (price / (price + old + F.lit(50000.0))).alias("p"),
        _copies(F.when(k % 41 == 0, F.lit(2)).otherwise(F.lit(1))).alias("_copy")).drop("_copy")


def credit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications under the orders' request ids (every fifth order has none; every 37th is delivered twice), up to 750 seconds apart from the
    transaction, with rule probabilities ``p0, p1, p2``."""
    j = _orders_with_customers(spark, sf_dir).filter("o_orderkey % 5 <> 0")
    k, c, bal = F.col("o_orderkey"), F.col("c_custkey"), F.col("c_acctbal")
    good, poor = F.greatest(bal, F.lit(0.0)) + F.lit(1), F.greatest(-bal, F.lit(0.0)) * F.lit(5) + F.lit(500)
    total = good + F.lit(2000.0) + poor
    return j.select(
        k.alias("src_id"), k.cast("string").alias("request_id"), F.timestamp_seconds(F.col("second") + k * 7 % 1500 - 750).alias("timestamp"),
        (F.lit(18) + c % 60).cast("int").alias("age"), (F.lit(6) + c * 7 % 67).cast("int").alias("duration_months"), (F.abs(bal) * F.lit(3.0) + F.lit(1)).alias("credit_amount"),
        _pick(_EMPLOYMENT, c % 5).alias("employment"), _pick(_PURPOSE, k % 5).alias("purpose"),
        (good / total).alias("p0"), (F.lit(2000.0) / total).alias("p1"), (poor / total).alias("p2"),
        _copies(F.when(k % 37 == 0, F.lit(2)).otherwise(F.lit(1))).alias("_copy")).drop("_copy")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


REQUESTS_SQL = f"""
placed AS (
  SELECT *, CAST(1709251200 AS BIGINT) + o_orderkey * 977 % 2592000 AS second, greatest(c_acctbal, CAST(0 AS DOUBLE)) * CAST(100 AS DOUBLE) AS old_org,
    CAST(o_custkey % 1000 AS DOUBLE) * CAST(125 AS DOUBLE) AS old_dest,
    greatest(c_acctbal, CAST(0 AS DOUBLE)) + 1 AS good, greatest(-c_acctbal, CAST(0 AS DOUBLE)) * 5 + 500 AS poor
  FROM orders JOIN customer ON o_custkey = c_custkey),
fraud_once AS (
  SELECT o_orderkey AS src_id, CAST(o_orderkey AS VARCHAR) AS request_id, second, CAST(1 + o_orderkey % 743 AS INTEGER) AS step,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'TRANSFER' WHEN '2' THEN 'CASH_OUT' WHEN '3' THEN 'PAYMENT' WHEN '4' THEN 'DEBIT' ELSE 'CASH_IN' END AS type,
    o_totalprice AS amount, old_org AS oldbalance_org, greatest(CAST(0 AS DOUBLE), old_org - o_totalprice) AS newbalance_orig,
    old_dest AS oldbalance_dest, old_dest + o_totalprice AS newbalance_dest, o_totalprice / (o_totalprice + old_org + CAST(50000 AS DOUBLE)) AS p
  FROM placed WHERE o_orderkey % 11 <> 0),
credit_once AS (
  SELECT o_orderkey AS src_id, CAST(o_orderkey AS VARCHAR) AS request_id, second + o_orderkey * 7 % 1500 - 750 AS second, CAST(18 + c_custkey % 60 AS INTEGER) AS age,
    CAST(6 + c_custkey * 7 % 67 AS INTEGER) AS duration_months, abs(c_acctbal) * CAST(3 AS DOUBLE) + 1 AS credit_amount,
    {_list(_EMPLOYMENT)}[CAST(c_custkey % 5 + 1 AS BIGINT)] AS employment, {_list(_PURPOSE)}[CAST(o_orderkey % 5 + 1 AS BIGINT)] AS purpose,
    good / (good + CAST(2000 AS DOUBLE) + poor) AS p0, CAST(2000 AS DOUBLE) / (good + CAST(2000 AS DOUBLE) + poor) AS p1, poor / (good + CAST(2000 AS DOUBLE) + poor) AS p2
  FROM placed WHERE o_orderkey % 5 <> 0)
"""
