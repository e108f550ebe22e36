"""Connected components by alternating large-star and small-star steps.

Edges are pairs of node values; each step is one grouping on a node, its output is written to the shared folder, and
the steps end when a step changes no edge.  No task holds a component: a node's neighbours are never collected, their
minimum is aggregated and joined back, and Spark splits skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step.  ``edges`` has each edge once as (a, b), a < b."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        own = least.select(F.col("m").alias("a"), F.col("a").alias("b"))
        out = joined.select(F.col("m").alias("a"), "b").union(own)
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most: int = 60) -> tuple[DataFrame, list[str]]:
    """(node, root) for each node of ``edges`` (columns a, b of one ordered type) but the roots themselves.

    root is the smallest node of the component.  Also returns the paths of the tables the result reads.
    """
    spark = edges.sparkSession
    now, path = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    stat = _sum(now)
    for _ in range(most):
        if stat[0] == 0:
            break
        new, new_path = keep(_star(_star(now, True), False), "edges")
        new_stat = _sum(new)
        drop(spark, path)
        now, path = new, new_path
        if new_stat == stat and _is_star(now):
            break
        stat = new_stat
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")), [path]


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _is_star(edges: DataFrame) -> bool:
    """Every b has one a and no a is a b."""
    ends = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    return edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count() == 0 and ends.count() == 0
