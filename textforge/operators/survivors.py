"""First rows, survivors and siblings of keys; near-duplicate names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as tx


def ranked(rows: DataFrame, keys: list, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; Spark keeps one row a key in each task before it shuffles."""
    return ranked(rows, keys, order).where("rank = 1").drop("rank")


def priority(value: Column, known: dict, default: int) -> Column:
    expr = F.lit(default)
    for k, p in known.items():
        expr = F.when(value == k, p).otherwise(expr)
    return expr


def fill_from_siblings(rows: DataFrame, key: str, order: list, item: str, column: str) -> DataFrame:
    """(key, winner, column, from_rank): the first sibling's item, the first value that isn't null and its sibling's rank."""
    r = ranked(rows, [key], order)
    given = F.when(F.col(column).isNotNull(), F.col("rank"))
    return r.groupBy(key).agg(F.min_by(item, "rank").alias("winner"), F.min_by(column, given).alias(column), F.min(given).cast("long").alias("from_rank"))


def audit(corpus: DataFrame, least: int = 10) -> DataFrame:
    """One row of counts: blank rows, equal lyrics, equal title and artist, too few tokens go one after the other."""
    rows = corpus.select("song_id", "title", "artist", "lyrics", F.size(tx.tokens(F.col("lyrics"))).alias("n"), (F.trim(F.coalesce("lyrics", F.lit(""))) == "").alias("blank"))
    rows = rows.withColumn("h", F.when(~F.col("blank"), F.sha2("lyrics", 256)).otherwise(F.concat(F.lit("id:"), F.col("song_id"))))
    rows = rows.withColumn("r1", F.when(F.col("blank"), None).otherwise(F.row_number().over(Window.partitionBy("h").orderBy("song_id"))))
    rows = rows.withColumn("live", F.col("r1") == 1)
    rows = rows.withColumn("r2", F.when(F.col("live"), F.row_number().over(Window.partitionBy("title", "artist", "live").orderBy("song_id"))))
    kept = (F.col("r2") == 1) & (F.col("n") >= least)
    return rows.agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if("blank").alias("blank"), F.count_if(F.col("r1") > 1).alias("same_lyrics"), F.count_if(F.col("r2") > 1).alias("same_title"),
        F.count_if((F.col("r2") == 1) & (F.col("n") < least)).alias("too_short"), F.count_if(kept).alias("rows_out"), F.min(F.when(kept, F.col("n"))).cast("long").alias("least"),
        F.percentile(F.when(kept, F.col("n")), 0.5).alias("middle"), F.max(F.when(kept, F.col("n"))).cast("long").alias("most"),
    )


def jaccard_pairs(rows: DataFrame, key: str, text: str, k: int, least: float) -> DataFrame:
    """(left_id, right_id, jaccard, left_n, right_n) of distinct texts whose sets of k-character grams are at least as alike as ``least``.

    A text is named by its smallest id, and left_n and right_n are the numbers of rows that have it.  Prefix filtering keeps it exact without meeting all
    pairs of a common gram: grams are ordered by their frequency, and two sets that are alike share one of the first
    n - ceil(least * n) + 1 grams of each.
    """
    given = rows.select(F.col(key).alias("id"), F.col(text).alias("text"))
    n = F.length("text")
    grams = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(k)))))
    sets = given.groupBy("text").agg(F.min("id").alias("t"), F.count(F.lit(1)).alias("members")).select("t", "members", grams.alias("grams"))
    exploded = sets.select("t", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    df = exploded.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("t").orderBy("df", "gram"))
    prefix = exploded.join(df, "gram").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("gram", "t", "n")
    near = prefix.alias("a").join(prefix.alias("b"), "gram").where(f"a.t < b.t AND a.n >= {least} * b.n AND b.n >= {least} * a.n")
    pairs = near.select(F.col("a.t").alias("x_t"), F.col("b.t").alias("y_t")).distinct()
    side = lambda n, c: sets.select(F.col("t").alias(f"{c}_t"), F.col("grams").alias(c), F.col("members").alias(f"{n}_n"))
    out = pairs.join(side("left", "x"), "x_t").join(side("right", "y"), "y_t")
    both = F.size(F.array_intersect("x", "y"))
    scored = out.withColumn("jaccard", both / (F.size("x") + F.size("y") - both)).where(F.col("jaccard") >= least)
    return scored.select(F.col("x_t").alias("left_id"), F.col("y_t").alias("right_id"), "jaccard", "left_n", "right_n")
