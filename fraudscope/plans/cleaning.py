"""Load -> validate -> coerce -> clean -> save, for both datasets.

Inputs are CSV (header, all-string scan) or Parquet; outputs are Parquet (or CSV)
tables.  The fitted cleaning statistics are saved next to each output so the
same numbers can be re-applied at scoring time (train/serve parity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import credit_cleaner, fraud_cleaner
from ..sources.io import load_credit_csv, load_fraud_csv, validate_schema, write_table
from ..schemas import RAW_CREDIT_COLUMNS, RAW_FRAUD_COLUMNS


def _load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if path.endswith(".csv") or kind.endswith("csv"):
        return load_fraud_csv(spark, path) if kind.startswith("fraud") else load_credit_csv(spark, path)
    df = spark.read.parquet(path)
    return validate_schema(df, RAW_FRAUD_COLUMNS if kind.startswith("fraud") else RAW_CREDIT_COLUMNS, kind)


def run_cleaning_pipeline(spark: SparkSession, fraud_path: str, credit_path: str, out_dir: str,
                          fmt: str = "parquet", input_format: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Clean both raw tables, write them under ``out_dir`` and return the cleaned DataFrames."""
    fraud_raw = _load(spark, fraud_path, f"fraud_{input_format}")
    credit_raw = _load(spark, credit_path, f"credit_{input_format}")
    fc = fraud_cleaner().fit(fraud_raw)
    cc = credit_cleaner().fit(credit_raw)
    fraud_clean, credit_clean = fc.transform(fraud_raw), cc.transform(credit_raw)
    write_table(fraud_clean, f"{out_dir}/cleaned_fraud", fmt=fmt)
    write_table(credit_clean, f"{out_dir}/cleaned_credit", fmt=fmt)
    spark.createDataFrame([(fc.stats.to_json(), cc.stats.to_json())], "fraud string, credit string") \
        .coalesce(1).write.mode("overwrite").json(f"{out_dir}/cleaning_stats")
    return spark.read.format(fmt).load(f"{out_dir}/cleaned_fraud") if fmt != "csv" else fraud_clean, \
        spark.read.format(fmt).load(f"{out_dir}/cleaned_credit") if fmt != "csv" else credit_clean
