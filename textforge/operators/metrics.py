"""Ranking, classification and error-rate metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(ranked: DataFrame, relevant: DataFrame, query: str, item: str) -> DataFrame:
    """ndcg, recall and mrr of each query; the ideal gain is that of the retrieved items, best first."""
    rows = ranked.join(relevant.withColumn("rel", F.lit(1)), [query, item], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    rows = rows.withColumn("best", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rel"), "rank")))
    gain = lambda place: F.sum(F.col("rel") / F.log2(F.col(place) + 1))
    totals = relevant.groupBy(query).agg(F.count(F.lit(1)).alias("total"))
    out = rows.groupBy(query).agg(gain("rank").alias("got"), gain("best").alias("ideal"), F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first")).join(totals, query, "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select(query, zero(F.col("got") / F.nullif("ideal", F.lit(0.0))).alias("ndcg"), zero(F.col("hits") / F.col("total")).alias("recall"), zero(1 / F.col("first")).alias("mrr"))


def f1(truth: Column, guess: Column) -> list[Column]:
    """tp, fp, fn, precision, recall and f1 of two boolean columns; 0 where undefined."""
    tp, fp, fn = F.count_if(truth & guess), F.count_if(~truth & guess), F.count_if(truth & ~guess)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    ]


def character_error(guess: str, truth: str) -> list[Column]:
    """Micro-averaged character error rate, share of exact matches and rows."""
    distance = F.levenshtein(F.col(guess), F.col(truth))
    return [F.round(F.sum(distance) / F.sum(F.greatest(F.length(truth), F.lit(1))), 6).alias("cer"), F.round(F.avg((F.col(guess) == F.col(truth)).cast("int")), 6).alias("exact"), F.count(F.lit(1)).alias("n")]
