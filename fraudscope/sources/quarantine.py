"""CSV scans that keep what they cannot read: good lines become rows, bad lines a side table with the reason.

One permissive scan (``_corrupt_record`` holds a line whose fields do not fit the columns) is split in two; both halves carry the file they
come from, and together they have every line of the input once.  A line is bad if it has too few or too many fields, or if a field that should be a number holds
something else; empty fields, ``NaN`` and nulls are missing values, not faults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import coerce_raw, string_schema

LINE = "_corrupt_record"
#: Texts that mean "no value" in a numeric field.  Fixed values.
NO_VALUE = ("", "nan", "null", "none", "na")


def _fields(line: F.Column, sep: str) -> F.Column:
    """Number of fields of a raw line; separators between quotes do not count."""
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def scan_csv(spark: SparkSession, path: str, expected: dict[str, str], header: bool = True, sep: str = ",") -> DataFrame:
    """All lines: the expected columns as text, ``line`` (as read, where it does not fit), ``file`` and ``reason`` (null for good lines; several are
    joined by commas)."""
    cols = list(expected)
    schema = T.StructType([*string_schema(cols).fields, T.StructField(LINE, T.StringType())])
    raw = (spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
           # a quote inside quotes is doubled; every field is looked at, whatever columns the query needs
           .option("escape", '"').option("columnPruning", False).option("enforceSchema", True).csv(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)))
    n = _fields(F.col(LINE), sep)
    shape = F.when(F.col(LINE).isNotNull(), F.when(n < len(cols), F.concat(F.lit("too_few_fields:"), n.cast("string"))).when(n > len(cols), F.concat(F.lit("too_many_fields:"), n.cast("string"))).otherwise("unreadable"))
    wrong = [F.when(F.col(LINE).isNull() & ~F.lower(F.trim(F.col(c))).isin(*NO_VALUE) & F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)").isNull(), F.lit(f"not_a_number:{c}"))
             for c, t in expected.items() if t != "string"]
    reason = F.nullif(F.concat_ws(",", shape, *wrong), F.lit(""))
    return raw.withColumn("reason", reason).withColumnRenamed(LINE, "line")


def split_csv(spark: SparkSession, path: str, expected: dict[str, str], header: bool = True, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(good rows with their types, bad lines as ``file, reason, line``).  A bad line is kept as it was read, or, where its fields fit, as the fields
    joined again."""
    rows = scan_csv(spark, path, expected, header, sep)
    good = coerce_raw(rows.filter("reason IS NULL").select(*expected), expected)
    again = F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit("")) for c in expected])
    bad = rows.filter("reason IS NOT NULL").select("file", "reason", F.coalesce("line", again).alias("line"))
    return good, bad
