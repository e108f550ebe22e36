"""Fuzzy matching: indel ratios in Arrow batches, candidates by shared character grams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from textforge.functions.unicode import skeleton


def indel(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), by bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """The best ratio of shared tokens, and shared ones with each side's rest, in sorted order."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(sorted(s)) for s in (x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel(one, two), *((indel(both, one), indel(both, two)) if both else (0.0,)))


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a part of the longer one of its length, or a shorter part at an end."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    starts = range(1 - len(a), len(b))
    return max(indel(a, b[max(0, i) : i + len(a)]) for i in starts)


def partial_token(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted(a: str, b: str) -> float:
    """The best of several ratios, those of tokens and of parts at a discount that grows with the difference in length."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    whole = indel(a, b)
    if longer < 1.5:
        return max(whole, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    return max(whole, scale * partial(a, b), 0.95 * scale * partial_token(a, b))


@pandas_udf(DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b, strict=True)])


def grams(text: Column, k: int) -> Column:
    n = F.length(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(k))))


def expand(queries: DataFrame, vocabulary: DataFrame, pool: int = 200, least: float = 70.0, keep: int = 3, rare: int = 10) -> DataFrame:
    """(token, term, rank, weight): vocabulary terms (term, df) close to query tokens (token, df, 0 for unknown ones).

    The ``pool`` terms with most shared 2- and 3-grams are compared, as they are and by their consonants alone; tokens that are
    known but rare expand only to terms as rare.
    """
    both = lambda c: F.explode(F.array_union(grams(F.col(c), 2), grams(F.col(c), 3)))
    q = queries.select("token", F.col("df").alias("known"), both("token").alias("gram"))
    v = vocabulary.select("term", "df", both("term").alias("gram")).join(q.select("gram").distinct(), "gram", "left_semi")
    shared = q.join(v, "gram").where((F.col("known") == 0) | (F.col("df") <= rare)).groupBy("token", "term").agg(F.count(F.lit(1)).alias("n")).where("token <> term")
    near = shared.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), "term"))).where(F.col("place") <= pool)
    bones = near.withColumn("x", skeleton(F.col("token"))).withColumn("y", skeleton(F.col("term")))
    by_bones = F.when((F.col("x") != F.col("token")) | (F.col("y") != F.col("term")), ratio("x", "y")).otherwise(0.0)
    rated = bones.withColumn("ratio", F.greatest(ratio("token", "term"), by_bones)).where(F.col("ratio") >= least)
    best = rated.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("ratio"), "term")).cast("long")).where(F.col("rank") <= keep)
    return best.select("token", "term", "rank", F.round(F.col("ratio") / 100 * 0.8, 6).alias("weight"))


def best_match(left: DataFrame, right: DataFrame, least: float = 60.0) -> DataFrame:
    """(left_id, right_id, score): the best token-set match among names that share a token; equal names first.

    Distinct names are compared, not their rows.  A row only has to avoid its own id, so the two smallest ids of a right name and the
    two best of a left one are enough.
    """
    words = lambda df, n: df.select(f"{n}_name").distinct().select(f"{n}_name", F.explode(F.array_distinct(F.split(f"{n}_name", " "))).alias("word"))
    pairs = words(left, "left").join(words(right, "right"), "word").select("left_name", "right_name").distinct()
    rated = pairs.withColumn("score", token_set_ratio("left_name", "right_name")).where(F.col("score") >= least)
    ids = right.select("right_id", "right_name").where("right_id IS NOT NULL").distinct()
    ids = ids.withColumn("rn", F.row_number().over(Window.partitionBy("right_name").orderBy("right_id"))).where("rn <= 2").drop("rn")
    each = rated.join(ids, "right_name").groupBy("left_name", "right_id").agg(F.max(F.struct((F.col("left_name") == F.col("right_name")).alias("same"), "score")).alias("m"))
    order = [F.desc("m.same"), F.desc("m.score"), "right_id"]
    two = each.withColumn("rn", F.row_number().over(Window.partitionBy("left_name").orderBy(*order))).where("rn <= 2").drop("rn")
    met = left.select("left_id", "left_name").join(two, "left_name").where("left_id <> right_id")
    return met.withColumn("rn", F.row_number().over(Window.partitionBy("left_id").orderBy(*order))).where("rn = 1").select("left_id", "right_id", F.round("m.score", 6).alias("score"))


def text_similarity(a: str, b: str) -> Column:
    """0 for short texts; else 0.7 of the token-set ratio and 0.3 of the Jaccard similarity of 4-grams, out of 100."""
    x, y = grams(F.col(a), 4), grams(F.col(b), 4)
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((F.length(a) < 20) | (F.length(b) < 20), F.lit(0.0)).otherwise(F.round(0.7 * token_set_ratio(F.col(a), F.col(b)) + 30 * jaccard, 2))
