"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Sizes are word counts.  Targets share a multiple of all words among the sources by weight; no target exceeds a multiple
of its source's size, and what is cut off goes to the others by weight.  A source of target T and size S is taken whole
floor(T / S) times; the rest is a weighted sample without replacement: each document's key is -ln(u) / quality, u
being a hash of its doc_id, and documents are taken in ascending order of key while half of the next one still fits.

A source's order is never made in one task.  Keys fall into SLICES slices by a monotone function of the key; sums for
each slice are added up first, so that only rows of one slice are sorted together.

Null texts have size 0; documents of size 0 are taken 0 times.  A null source is a source of its own, the last one.
Rows of one doc_id get the same key and an order by size, those of one size by their texts' hashes where texts are taken; equal
rows have one result each.  Texts have no bound of length.  Columns but doc_id, text and source, whatever their names, are
ignored, and without ``source`` all is one source; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SLICES = 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.5 to 1.5: 0.5 and the share of characters that are letters or white space."""
    t = F.coalesce(text, F.lit(""))
    clean = F.length(F.regexp_replace(t, "[^\\p{L}\\s]+", ""))
    return F.lit(0.5) + F.when(F.length(t) > 0, clean / F.length(t)).otherwise(F.lit(0.0))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of md5."""
    digest = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources from their sizes (source, source_size): one row for each source, so one task orders them."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(order)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(MOST))
    rows = rows.withColumn("total", F.sum("source_size").over(every) * F.lit(SHARE)).withColumn("tip", F.col("cap") / F.col("weight"))
    # Sources reach their caps in order of cap / weight.  With those before this one at their caps, the others share the
    # rest by weight: the first source that stays below its cap on that share sets the level for all after it.
    before = Window.orderBy("tip", "weight", F.col("source").asc_nulls_last())
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(before.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("tip"), F.struct("tip", "level"))).over(every)["level"])
    target = F.round(F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))), 6)
    return rows.select("source", "source_size", target.alias("target"))


def _mixed(docs: DataFrame, seed: int, carry: list[str]) -> DataFrame:
    source = F.col("source").cast("string").alias("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source")
    rows = docs.select("doc_id", source, word_count(F.col("text")).alias("size"), quality(F.col("text")).alias("quality"), *([F.xxhash64("text").alias("tie"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else [F.lit(0).alias("tie")]))
    rows = rows.withColumn("key", -F.ln(uniform(F.col("doc_id"), seed)) / F.col("quality"))
    rows = rows.withColumn("slice", F.floor((1 - F.exp(-F.col("key"))) * SLICES).cast("int"))
    if not carry:
        rows, _ = keep(rows, "sizes")  # texts are read once
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    prior = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("prior", F.coalesce(F.sum("words").over(prior), F.lit(0)))
    plan = sums.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "slice", "prior", "source_size", "target")
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.slice") == F.col("p.slice")))
    within = Window.partitionBy("r.source", "r.slice").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("prior") + F.sum("size").over(within)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    fits = (reached - F.col("size") / 2 <= rest) & (F.col("size") > 0) & (rest > 0)
    return joined.withColumn("times", (epochs + F.when(fits, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for each row of ``docs``."""
    rows = _mixed(docs, seed, [])
    return rows.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", "times", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def take(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: the sum of its ``times``, repeated and null doc_ids included."""
    rows = _mixed(docs, seed, docs.columns).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])
