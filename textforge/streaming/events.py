"""Events as a stream: the batch expressions of operators.events with watermarks, refusals and exactly-once sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textforge.operators import events as e


def read(spark: SparkSession, path: str, schema: StructType, files: int = 10) -> DataFrame:
    """Parquet files of a folder as a stream of at most ``files`` new files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduplicated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once each by event_id, as far back as the watermark; event time becomes an instant."""
    return e.timed(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def window_counts(stream: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Counts by window, user and type."""
    out = stream.groupBy(F.window("ts", size).alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "user_id", "event_type", "n")


def split_refused(stream: DataFrame, kinds: list[str], now: str) -> DataFrame:
    """Adds ``reason``: null for accepted events."""
    return stream.withColumn("reason", e.reason(kinds, now))


def write_split(stream: DataFrame, accepted: str, refused: str, checkpoint: str):
    """One query that appends accepted events and refused ones to two folders, once for each batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        batch.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{refused}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
