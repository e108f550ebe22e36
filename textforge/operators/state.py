"""State of long collections: appended tails, watermarks, attempts, keys, stages and look-ups, as functions of tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as tx


def tail(corpus: DataFrame, done: DataFrame, key: str, digest: Column) -> tuple[DataFrame, bool]:
    """Rows whose key isn't done yet; and whether all that is done is still the same (``done`` has key and digest).

    What was computed for a changed row can't be trusted, so callers compute all anew if it isn't.
    """
    now = corpus.select(key, digest.alias("now"))
    changed = done.join(now, key, "left").where("now IS NULL OR now <> digest")
    return corpus.join(done.select(key), key, "left_anti"), changed.isEmpty()


def appended(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Windows of new texts behind the old ones: their owners, counted from 0 in ``new``, go on from the highest old one."""
    top = old.agg(F.coalesce(F.max(owner), F.lit(-1)).alias("top"))
    shifted = new.crossJoin(F.broadcast(top)).withColumn(owner, (F.col(owner) + F.col("top") + 1).cast(old.schema[owner].dataType)).drop("top")
    return old.unionByName(shifted)


def watermark(corpus: DataFrame, before: str | None, digest: str, now: str) -> str:
    """A record (JSON) of how far a corpus was processed: rows, how many of them are new, digest, time."""
    rows = corpus.count()
    was = json.loads(before)["rows"] if before else 0
    return json.dumps({"rows": rows, "new_songs": rows - was, "digest": digest, "updated_at": now}, sort_keys=True)


def requeue(queue: DataFrame, ids: DataFrame, owner: str, error: Column, most: int = 3) -> DataFrame:
    """Rows of ``ids`` that ``owner`` failed at go back to new, without a lease, while attempts are left; then they're dead."""
    rows = queue.join(ids.select("id", F.lit(True).alias("failed")), "id", "left")
    mine = F.coalesce(F.col("failed") & (F.col("owner") == owner) & (F.col("status") == "claimed"), F.lit(False))
    status = F.when(mine, F.when(F.col("attempts") < most, "new").otherwise("dead")).otherwise(F.col("status"))
    kind = queue.schema["expires"].dataType
    return rows.select("id", status.alias("status"), F.when(~mine, F.col("owner")).alias("owner"), F.when(~mine, F.col("expires")).cast(kind).alias("expires"), "attempts", F.when(mine, error).alias("last_error"))


def rekeyed(rows: DataFrame, ids: str, key: str, new: Column) -> DataFrame:
    """Keys set anew where the new key is free: not another row's, old or new; else the old key stays."""
    wanted = rows.withColumn("__new", new)
    rank = F.row_number().over(Window.partitionBy("__new").orderBy(ids))
    wanted = wanted.withColumn("__rank", rank)
    taken = rows.select(F.col(key).alias("__new"), F.col(ids).alias("__holder"))
    holders = taken.groupBy("__new").agg(F.min("__holder").alias("__holder"))
    out = wanted.join(holders, "__new", "left")
    free = F.col("__new").isNotNull() & (F.col("__rank") == 1) & (F.col("__holder").isNull() | (F.col("__holder") == F.col(ids)))
    return out.withColumn(key, F.when(free, F.col("__new")).otherwise(F.col(key))).withColumn("rekeyed", free).select(*rows.columns, "rekeyed")


def logged(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log of attempts with new ones behind it, numbered on."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("id", F.row_number().over(Window.orderBy("candidate_id", "stage")).cast("long"))  # the attempts of one batch
    return log.unionByName(numbered.crossJoin(F.broadcast(top)).withColumn("id", F.col("id") + F.col("top")).drop("top").select(*log.columns))


def migrated(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table with columns that older versions lack, as nulls."""
    return rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in rows.columns])


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Each wanted key, whether it's there, and whether it has a text."""
    known = rows.groupBy(key).agg(F.max(F.coalesce(F.trim("text") != "", F.lit(False))).alias("has_text"))
    return keys.select(key).distinct().join(known, key, "left").select(key, F.col("has_text").isNotNull().alias("known"), F.coalesce("has_text", F.lit(False)).alias("has_text"))


def cascade(stages: DataFrame, item: str, order: list[str], good: Column) -> DataFrame:
    """The first stage, in order, whose result is good, for each item; else the last outcome: item, stage, outcome, tried."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    rows = stages.withColumn("place", place).where("place > 0").withColumn("good", F.coalesce(good, F.lit(False)))
    first = F.min(F.when(F.col("good"), F.col("place")))
    per = rows.groupBy(item).agg(first.alias("hit"), F.max("place").alias("last"))
    names = F.array(*map(F.lit, order))
    return per.select(item, F.element_at(names, F.coalesce("hit", "last").cast("int")).alias("stage"), F.when(F.col("hit").isNotNull(), "found").otherwise("missed").alias("outcome"), F.coalesce("hit", "last").alias("tried"))


def reparse(pages: DataFrame, candidates: DataFrame, artist: Column) -> DataFrame:
    """Candidates whose artist is blank, with the one that their page's title gives."""
    blank = candidates.where("artist IS NULL OR trim(artist) = ''")
    found = blank.drop("artist").join(pages.select("candidate_id", "page_title"), F.col("id") == F.col("candidate_id")).withColumn("artist", artist).where("artist <> ''")
    return found.select("id", "artist")


def folded_digest(text: Column) -> Column:
    return F.sha2(tx.fold(text), 256)
