"""Work-queue transitions as pure functions of a table: a single writer applies them and writes the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claim(queue: DataFrame, owner: str, limit: int, now: Column, lease: str = "10 minutes", most: int = 3) -> DataFrame:
    """The queue after ``owner`` took the first ``limit`` new rows with attempts left, in order of id."""
    free = queue.where((F.col("status") == "new") & (F.col("attempts") < most)).orderBy("id").limit(limit).select("id", F.lit(True).alias("taken"))
    rows = queue.join(free, "id", "left")
    t = F.coalesce("taken", F.lit(False))
    return rows.select(
        "id", F.when(t, "claimed").otherwise(F.col("status")).alias("status"), F.when(t, F.lit(owner)).otherwise(F.col("owner")).alias("owner"),
        F.when(t, now + F.expr(f"INTERVAL {lease}")).otherwise(F.col("expires")).alias("expires"), (F.col("attempts") + t.cast("long")).alias("attempts"),
    )


def reset_orphans(queue: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Claimed rows whose lease ran out, or has no end, become new again."""
    lost = (F.col("status") == "claimed") & (F.lit(force) | F.col("expires").isNull() | (F.col("expires") < now))
    kind = queue.schema["expires"].dataType
    return queue.select("id", F.when(lost, "new").otherwise(F.col("status")).alias("status"), F.when(~lost, F.col("owner")).alias("owner"), F.when(~lost, F.col("expires")).cast(kind).alias("expires"), "attempts")


def sweep(queue: DataFrame, most: int = 3) -> DataFrame:
    """New or failed rows without attempts left become dead."""
    spent = F.col("status").isin("new", "failed") & (F.col("attempts") >= most)
    return queue.withColumn("status", F.when(spent, "dead").otherwise(F.col("status")))


def finish(queue: DataFrame, ids: DataFrame, owner: str, status: str, most: int = 3) -> DataFrame:
    """Rows of ``ids`` that ``owner`` holds get ``status``; failures go back to new while attempts are left, else dead."""
    rows = queue.join(ids.select("id", F.lit(True).alias("done")), "id", "left")
    mine = F.coalesce("done", F.lit(False)) & (F.col("owner") == owner)
    to = F.when(F.lit(status) != "failed", F.lit(status)).when(F.col("attempts") < most, "new").otherwise("dead")
    return rows.withColumn("status", F.when(F.coalesce(mine, F.lit(False)), to).otherwise(F.col("status"))).drop("done")


def insert_ignore(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key is neither in the table nor in an earlier new row."""
    from .survivors import first_of

    return first_of(new, [key], [order]).join(table.select(key), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The table with the last new row of each key in place of, or beside, its own."""
    from .survivors import first_of

    last = first_of(new, [key], [F.desc(order)]).drop(order)
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last)


def fill_nulls(table: DataFrame, update: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null cells filled from an update of the same key; others stay."""
    u = update.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    rest = [c for c in table.columns if c not in columns and c != key]
    return table.join(u, key, "left").select(key, *rest, *[F.coalesce(c, f"new_{c}").alias(c) for c in columns])


def keep_newest(snapshots: DataFrame, order: str, keep: int) -> DataFrame:
    from pyspark.sql import Window

    return snapshots.withColumn("stale", F.row_number().over(Window.orderBy(F.desc(order))) > keep)
