"""R3 as a stream: fraud and credit requests of one id, each scored in its own stream, meet in a stream-stream join.

Both sides carry a watermark, and halves pair only within a time bound, so a half is held in state until the watermark has passed the
last moment at which its other half could come; then it leaves as a row of its own (outer join) and its state goes.  State
is bounded by the rows of ``within`` plus ``late``, whatever the length of the streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_scores(fraud: DataFrame, credit: DataFrame, key: str = "request_id", ts: str = "timestamp", within: str = "10 minutes", late: str | None = "15 minutes") -> DataFrame:
    """``key, fraud_time, credit_time, status, fraud, credit``; the last two are structs of the other columns of each side, null where that half
    did not come within the bound.  ``late`` is the streams' watermark, None where they have one (``once``).  Works on streams and,
    as the plain join, on tables."""
    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.withWatermark(ts, late) if df.isStreaming and late else df
        rest = [c for c in df.columns if c not in (key, ts)]
        return df.select(F.col(key).alias(f"{name}_key"), F.col(ts).alias(f"{name}_time"), F.struct(*rest).alias(name))

    bound = F.expr(f"INTERVAL {within}")
    f, c = side(fraud, "fraud"), side(credit, "credit")
    meet = (F.col("fraud_key") == F.col("credit_key")) & (F.col("credit_time") >= F.col("fraud_time") - bound) & (F.col("credit_time") <= F.col("fraud_time") + bound)
    status = F.when(F.col("credit_key").isNull(), "fraud_only").when(F.col("fraud_key").isNull(), "credit_only").otherwise("complete")
    return f.join(c, meet, "full_outer").select(F.coalesce("fraud_key", "credit_key").alias(key), "fraud_time", "credit_time", status.alias("status"), "fraud", "credit")


def once(requests: DataFrame, key: str = "request_id", ts: str = "timestamp", late: str = "15 minutes") -> DataFrame:
    """Requests delivered again within ``late`` of the first delivery are dropped; the state of an id goes with the watermark."""
    if requests.isStreaming:
        return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return requests.dropDuplicates([key])
