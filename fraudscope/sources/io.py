"""Scans, schema checks, coercion and sinks.

* CSV inputs are read with an explicit all-string schema (no inference pass) and
  coerced with ``try_cast``: unparsable numbers become NULL, ``NaN`` becomes NULL,
  surrounding blanks are ignored; strings keep NULL as NULL.
* Sinks write Parquet; appends to the prediction log are partitioned by date so
  "most recent N" reads prune old partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import missing_columns
from ..schemas import GERMAN_RAW_COLUMNS, RAW_CREDIT_COLUMNS, RAW_FRAUD_COLUMNS
from .tables import read_table


def string_schema(cols: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def read_csv_strings(spark: SparkSession, path: str, cols: list[str] | None = None, header: bool = True,
                     sep: str = ",") -> DataFrame:
    """CSV scan with every column as string. Without ``cols`` the header names are used."""
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if cols is not None:
        reader = reader.schema(string_schema(cols))
    else:
        reader = reader.option("inferSchema", False)
    return reader.csv(path)


def validate_schema(df: DataFrame, required, dataset: str) -> DataFrame:
    """Raise if required columns are missing (no job) or the table is empty (one tiny job)."""
    miss = missing_columns(df, required)
    if miss:
        raise ValueError(f"[{dataset}] Missing required columns: {miss}")
    if df.isEmpty():
        raise ValueError(f"[{dataset}] Dataset is empty")
    return df


def coerce_types(df: DataFrame, numeric: list[str], string: list[str], keep: list[str] | None = None) -> DataFrame:
    """Lenient coercion: numeric columns -> DOUBLE (bad -> NULL, NaN -> NULL), strings kept with NULLs."""
    keep = keep or []
    num = {}
    for c in numeric:
        x = F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)")
        num[c] = F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)
    other = [c for c in df.columns if c not in numeric and c not in string and c not in keep]
    return df.select(*keep, *[num[c].alias(c) if c in num else F.col(c).cast("string").alias(c)
                              for c in numeric + string], *other)


def coerce_raw(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    numeric = [c for c, t in expected.items() if t != "string" and c in df.columns]
    string = [c for c, t in expected.items() if t == "string" and c in df.columns]
    return coerce_types(df, numeric, string)


def load_fraud_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S4-S7: header CSV of raw transactions, validated and coerced."""
    df = read_csv_strings(spark, path)
    validate_schema(df, RAW_FRAUD_COLUMNS, "FraudData")
    return coerce_raw(df, RAW_FRAUD_COLUMNS)


def load_credit_csv(spark: SparkSession, path: str) -> DataFrame:
    """S2 + S4-S7: header CSV of applicants, validated and coerced."""
    df = read_csv_strings(spark, path)
    validate_schema(df, RAW_CREDIT_COLUMNS, "CreditData")
    return coerce_raw(df, RAW_CREDIT_COLUMNS)


def load_german_raw(spark: SparkSession, path: str) -> DataFrame:
    """S3: headerless space-separated German credit file with the supplied names."""
    df = read_csv_strings(spark, path, cols=GERMAN_RAW_COLUMNS, header=False, sep=" ")
    numeric = ["duration_months", "credit_amount", "installment_rate", "residence_since", "age",
               "existing_credits", "num_dependents", "credit_risk"]
    return coerce_types(df, numeric, [c for c in GERMAN_RAW_COLUMNS if c not in numeric])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def transactions_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-typed transactions with junk values (for coercion): 'abc', 'NaN', blanks, exponents, ''."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("txn_id"),
        F.when(k % 61 == 0, "abc").when(k % 67 == 0, "NaN")
        .when(k % 71 == 0, F.concat(F.lit(" "), (k % 743).cast("string"), F.lit(" ")))
        .otherwise((F.lit(1) + k % 743).cast("string")).alias("step"),
        F.when(k % 73 == 0, "1.5e3").when(k % 79 == 0, "")
        .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".25"))).alias("amount"),
        F.when(k % 83 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("type"),
    )
