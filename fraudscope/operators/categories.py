"""Categories as a stored table instead of a list on the driver (M2/M3 for columns with very many values).

``category_table`` numbers the values of each column in alphabetical order; ``with_codes`` joins the numbers to rows; ``sparse_vectors`` turns them into
one-hot vectors that hold their non-zero places only.  Neither values nor rows reach the driver, only the number of values per column.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import places

CATEGORY_SCHEMA = "col string, value string, code long"
#: Beyond every column's codes: encoded as all zeros.
UNKNOWN = float(2**31 - 2)


def category_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``col, value, code``: the distinct non-null values, numbered from zero by column in alphabetical order."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")
    return places(df.select(cells).select("e.*").filter("value IS NOT NULL").distinct(), "col", "value", "code")


def store_categories(table: DataFrame, path: str) -> DataFrame:
    table.write.mode("overwrite").partitionBy("col").parquet(path)
    return read_categories(table.sparkSession, path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATEGORY_SCHEMA).parquet(path)


def with_codes(df: DataFrame, columns: list[str], table: DataFrame) -> DataFrame:
    """``df`` with ``<column>_code``; null where the value is null or not in the table.  A plain join per column: Spark broadcasts a small table and
    splits a hot value's rows where it does not."""
    for c in columns:
        codes = table.filter(F.col("col") == c).select(F.col("value").alias("_value"), F.col("code").alias(f"{c}_code"))
        df = df.join(codes, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
    return df


def sparse_vectors(df: DataFrame, numeric: list[str], columns: list[str], table: DataFrame, output: str = "features_vec") -> DataFrame:
    """``df`` with one vector: the numeric columns, then the one-hot places of each column; unknown values are all zeros."""
    sizes = {r["col"]: int(r["n"]) for r in table.filter(F.col("col").isin(columns)).groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a column
    out = with_codes(df, columns, table)
    hot = [c for c in columns if sizes.get(c)]
    for c in hot:
        out = out.withColumn(f"_{c}_at", F.coalesce(F.col(f"{c}_code").cast("double"), F.lit(UNKNOWN)))
    if hot:
        # the encoder learns a column's size from its largest code
        ends = df.sparkSession.createDataFrame([tuple(float(sizes[c] - 1) for c in hot)], [f"_{c}_at" for c in hot])
        encoder = OneHotEncoder(inputCols=[f"_{c}_at" for c in hot], outputCols=[f"_{c}_hot" for c in hot], handleInvalid="keep", dropLast=True)
        out = encoder.fit(ends).transform(out)
    out = VectorAssembler(inputCols=[*numeric, *(f"_{c}_hot" for c in hot)], outputCol=output, handleInvalid="keep").transform(out)
    return out.drop(*(f"_{c}_{x}" for c in hot for x in ("at", "hot")))
