"""Per-minute prediction monitoring, the same plan for batch and streaming.

Batch: a tumbling one-minute window aggregate.  Stream: the same aggregate with a
watermark, so state for a minute is dropped once the watermark passes it and the
query can run in append mode for as long as the log keeps growing.  The stream's result is a table
keyed by window (``start_minute_table``), so neither the driver nor the state holds the past.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from .tables import read_newest, start_table


def per_minute_stats(log: DataFrame, ts_col: str = "timestamp", flag_col: str = "is_fraud",
                     version_col: str = "model_version") -> DataFrame:
    w = F.window(F.col(ts_col), "1 minute")
    agg = log.groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).cast("long").alias("n_predictions"),
        F.avg(F.col(flag_col).cast("double")).alias("fraud_rate"),
        # the version of the newest prediction, whatever order the names have ("v9" < "v10")
        F.max(F.struct(F.col(ts_col).alias("t"), F.col(version_col).alias("v")))["v"].alias("model_version"),
    )
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "n_predictions", "fraud_rate", "model_version")


def per_minute_stream(log_stream: DataFrame, watermark: str = "10 minutes", ts_col: str = "timestamp",
                      flag_col: str = "is_fraud", version_col: str = "model_version") -> DataFrame:
    """Streaming form: watermark + tumbling window; emit in append mode."""
    return per_minute_stats(log_stream.withWatermark(ts_col, watermark), ts_col, flag_col, version_col)


MINUTE_SCHEMA = "window_start timestamp, window_end timestamp, n_predictions long, fraud_rate double, model_version string"


class LateRows(StreamingQueryListener):
    """Counts the rows that came behind the watermark and were left out, per query (``counts``: run id -> rows)."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.counts[str(event.runId)] = 0

    def onQueryProgress(self, event):
        p = event.progress
        self.counts[str(p.runId)] = self.counts.get(str(p.runId), 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def start_minute_table(log_stream: DataFrame, path: str, checkpoint: str, watermark: str = "10 minutes", available_now: bool = False):
    """The per-minute table: windows that changed in a micro-batch are written with it; the watermark drops a minute's state."""
    return start_table(per_minute_stream(log_stream, watermark), path, checkpoint, "update", available_now)


def read_minute_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each minute, open minutes included."""
    return read_newest(spark, path, T.StructType.fromDDL(MINUTE_SCHEMA), ["window_start", "window_end"])
