"""Mood labels, compositions, calibration and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentiment(score: Column, above: float, below: float) -> Column:
    return F.when(score > above, "positive").when(score < below, "negative").otherwise("neutral")


def dominant(columns: list[str], bias: list[float], floor: float = 0.55) -> Column:
    """The first largest column after its bias; neutral below the floor."""
    values = F.array(*[F.col(c) + b for c, b in zip(columns, bias, strict=True)])
    names = F.array(*map(F.lit, columns))
    return F.when(F.array_max(values) < floor, "neutral").otherwise(F.element_at(names, F.array_position(values, F.array_max(values)).cast("int")))


def composition(lines: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each column's share of the total mass; equal shares where there is next to none."""
    sums = lines.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    even = F.lit(round(1 / len(columns), 4))
    return sums.select(key, *[F.when(total < 1e-6, even).otherwise(F.round(F.col(c) / total, 4)).alias(c) for c in columns])


def grid(rows: DataFrame, biases: DataFrame, held: DataFrame, floor: float = 0.55) -> DataFrame:
    """F1 of each bias with each group held out; biases and groups are short lists."""
    every = rows.crossJoin(biases).crossJoin(held).where("label <> held")
    hit = F.col("joy") + F.col("bias") >= floor
    c = every.groupBy("held", "bias").agg(F.count_if(F.col("y") & hit).alias("tp"), F.count_if(~F.col("y") & hit).alias("fp"), F.count_if(F.col("y") & ~hit).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return c.select("held", F.round("bias", 2).alias("bias"), F.round(F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0), 6).alias("f1"))


def fit_probe(rows: DataFrame, c: float = 1.0, iterations: int = 100) -> DataFrame:
    """(pos, coefficient) of columns embedding and y; pos -1 is the intercept.  The penalty is 1 / (C n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), F.col("y").alias("label"))
    n = data.count()
    model = LogisticRegression(regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=iterations).fit(data)
    values = [(-1, float(model.intercept)), *enumerate(map(float, model.coefficients))]
    return rows.sparkSession.createDataFrame(values, "pos long, coefficient double")
