"""Events: validation, windows and sessions; the same expressions serve batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reason(kinds: list[str], now: str, ahead: int = 300, most_bytes: int = 4096) -> Column:
    """Why an event is refused; null when it's accepted.  The first broken rule counts."""
    limit = F.to_timestamp_ntz(F.lit(now)) + F.expr(f"INTERVAL {ahead} SECOND")
    return (
        F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(kinds), "event_type")
        .when(F.col("ts").isNull(), "timestamp")
        .when(F.col("ts") > limit, "future")
        .when(F.col("user_id").isNull() | (F.length(F.col("user_id").cast("string")) > 64), "user_id")
        .when(F.col("value") < 0, "value")
        .when(F.octet_length("props") > most_bytes, "metadata_size")
        .when(~F.col("props").rlike("^\\s*\\{.*\\}\\s*$"), "metadata")
    )


def timed(events: DataFrame) -> DataFrame:
    """Event time as an instant (UTC session), which watermarks and windows want."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, step: str | None) -> DataFrame:
    """Counts and sums by window and type."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    out = timed(events).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    out = timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
