"""Test events as a stream (an extension: captured output has no times of its own)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Passed, failed and skipped tests of each run and window; events (run_id, ts, test, action) later than `late` are dropped."""
    w = F.window(time, window)
    counted = events.withWatermark(time, late).where(F.col("action").isin("pass", "fail", "skip")).groupBy("run_id", w.alias("w"))
    out = counted.agg(*[F.count_if(F.col("action") == a).alias(c) for a, c in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))])
    return out.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "passed", "failed", "skipped", F.when(F.col("failed") > 0, "fail").otherwise("pass").alias("status"))


def first_status(events: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first event of each run and test within the watermark; repeated reports are dropped with bounded state."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["run_id", "test"])
