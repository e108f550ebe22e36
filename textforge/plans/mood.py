"""Queries of mood attribution: probes, lines, composition, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.operators import mood
from textforge.operators import vectors as v

from .registry import Tables, query

PROBE = "probe AS (SELECT * FROM (VALUES ('joy', 1), ('sadness', 2), ('anger', 3)) p(label, seed))"
SCORES = f"""{PROBE}, s AS (SELECT vec_id, label, seed, 1 / (1 + exp(-(sum(x * (((pos * seed) % 7) - 3) / 4.0::DOUBLE)))) AS p
FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) e CROSS JOIN probe GROUP BY vec_id, probe.label, seed)""".replace("vec_id, label, seed, 1", "vec_id, probe.label, seed, 1")
WIDE = f"{SCORES}, w AS (SELECT vec_id, max(CASE WHEN label = 'joy' THEN p END) AS joy, max(CASE WHEN label = 'sadness' THEN p END) AS sadness, max(CASE WHEN label = 'anger' THEN p END) AS anger FROM s GROUP BY vec_id)"


def probe_weight(seed: int):
    return lambda i: (i * seed % 7 - 3) / F.lit(4.0)


def wide(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    for seed, label in enumerate(("joy", "sadness", "anger"), 1):
        coef = F.transform(F.sequence(F.lit(0), F.size("v") - 1), probe_weight(seed))
        rows = rows.withColumn(label, 1 / (1 + F.exp(-v.dot(F.col("v"), coef))))
    return rows.drop("v")


@query(f"WITH {WIDE} SELECT vec_id, round(joy, 6) AS joy, round(sadness, 6) AS sadness, round(anger, 6) AS anger FROM w")
def probe_scores(t: Tables) -> DataFrame:
    return wide(t).select("vec_id", *[F.round(c, 6).alias(c) for c in ("joy", "sadness", "anger")])


@query(f"""WITH {WIDE}, b AS (SELECT vec_id, joy - 0.08::DOUBLE AS joy, sadness - 0.12::DOUBLE AS sadness, anger + 0.12::DOUBLE AS anger FROM w)
SELECT vec_id, CASE WHEN greatest(joy, sadness, anger) < 0.55 THEN 'neutral' WHEN joy >= sadness AND joy >= anger THEN 'joy' WHEN sadness >= anger THEN 'sadness' ELSE 'anger' END AS label FROM b""")
def line_labels(t: Tables) -> DataFrame:
    return wide(t).select("vec_id", mood.dominant(["joy", "sadness", "anger"], [-0.08, -0.12, 0.12]).alias("label"))


@query(f"""WITH {WIDE}, g AS (SELECT vec_id // 4 AS song_id, sum(joy) AS j, sum(sadness) AS s, sum(anger) AS a FROM w GROUP BY 1)
SELECT song_id, round(j / (j + s + a), 4) AS joy, round(s / (j + s + a), 4) AS sadness, round(a / (j + s + a), 4) AS anger FROM g""")
def mood_composition(t: Tables) -> DataFrame:
    return mood.composition(wide(t).withColumn("song_id", F.expr("vec_id DIV 4")), "song_id", ["joy", "sadness", "anger"])


@query(f"""WITH {WIDE}, g AS (SELECT vec_id // 4 AS song_id, avg(joy) - avg((sadness + anger) / 2) AS x FROM w GROUP BY 1) SELECT song_id, round(x, 6) AS polarity, CASE WHEN x > 0 THEN 'positive' WHEN x < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM g""")
def mood_polarity(t: Tables) -> DataFrame:
    g = wide(t).groupBy(F.expr("vec_id DIV 4").alias("song_id")).agg((F.avg("joy") - F.avg((F.col("sadness") + F.col("anger")) / 2)).alias("x"))
    return g.select("song_id", F.round("x", 6).alias("polarity"), mood.sentiment(F.col("x"), 0.0, -0.1).alias("label"))


@query(f"""WITH {WIDE}, x AS (SELECT e.label % 2 = 0 AS y, e.label, joy FROM w JOIN embeddings e USING (vec_id)), g AS (SELECT i / 20.0::DOUBLE - 0.15::DOUBLE AS bias FROM range(0, 7) r(i)),
c AS (SELECT h.held, bias, count_if(y AND joy + bias >= 0.55) AS tp, count_if(NOT y AND joy + bias >= 0.55) AS fp, count_if(y AND joy + bias < 0.55) AS fn FROM x CROSS JOIN g CROSS JOIN (SELECT DISTINCT label AS held FROM embeddings) h WHERE x.label <> h.held GROUP BY ALL)
SELECT held, round(bias, 2) AS bias, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1 FROM c""")
def calibration_grid(t: Tables) -> DataFrame:
    rows = wide(t).join(t.embeddings.select("vec_id", "label"), "vec_id").select((F.col("label") % 2 == 0).alias("y"), "label", "joy")
    return mood.grid(rows, t.spark.range(7).select((F.col("id") / 20.0 - 0.15).alias("bias")), t.embeddings.select(F.col("label").alias("held")).distinct())


@query()
def logreg_probe(t: Tables) -> DataFrame:
    """Coefficients of a logistic regression of even labels on vectors (MLlib, no penalty on scale)."""
    return mood.fit_probe(t.embeddings.select("embedding", (F.col("label") % 2).cast("double").alias("y")))
