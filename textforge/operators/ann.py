"""An inverted-file index of vectors: cells around centres, of which a search reads the nearest few."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import top_k
from .vectors import dot, nearest, unit

#: Rows that the centres are fitted to, and rows from which an index beats reading all.
SAMPLE, LARGE = 4096, 50_000


def kind(n: int, wanted: str = "auto") -> str:
    """flat or cells."""
    if wanted not in ("auto", "flat", "cells"):
        raise ValueError(f"unknown kind {wanted}")
    return wanted if wanted != "auto" else "cells" if n >= LARGE else "flat"


def centres(rows: DataFrame, key: str, vector: str, cells: int = 32, rounds: int = 12, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres by k-means on the ``sample`` rows of smallest hash: a list of fixed length, whatever the table's."""
    some = rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(sample).select(unit(F.col(vector)).alias("v")).collect()
    x = np.array([r.v for r in some], dtype=float)
    at = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        of = (x @ at.T).argmax(axis=1)
        for c in range(len(at)):
            if (of == c).any():
                mean = x[of == c].mean(axis=0)
                at[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return at


def _cells(rows: DataFrame, at: np.ndarray, vector: str) -> DataFrame:
    """Adds ``order``: cells from the nearest to the farthest."""
    table = F.from_json(F.lit(json.dumps(at.tolist())), "array<array<double>>")  # a constant
    scored = F.transform(table, lambda c, i: F.struct((-dot(F.col(vector), c)).alias("d"), i.alias("cell")))
    return rows.withColumn("order", F.transform(F.array_sort(scored), lambda s: s["cell"]))


def build(rows: DataFrame, key: str, vector: str, at: np.ndarray) -> DataFrame:
    """(key, v, cell) of every row; callers write it partitioned by cell."""
    unit_rows = rows.select(F.col(key), unit(F.col(vector)).alias("v"))
    return _cells(unit_rows, at, "v").select(key, "v", F.col("order")[0].alias("cell"))


def search(index: DataFrame, queries: DataFrame, at: np.ndarray, key: str, qid: str, vector: str, k: int, probes: int) -> DataFrame:
    """(qid, key, score, rank): the k best of the ``probes`` nearest cells of each query."""
    q = _cells(queries.select(F.col(qid).alias("__id"), unit(F.col(vector)).alias("q")), at, "q").select("__id", "q", F.explode(F.slice("order", 1, probes)).alias("cell"))
    found = nearest(q, index.select(key, "v", "cell").sortWithinPartitions("cell"), "__id", key, k, others=False, cell="cell").withColumnRenamed("__id", qid)
    return top_k(found.withColumn("score", F.round("score", 6)), qid, key, "score", k)


def recall(found: DataFrame, exact: DataFrame, qid: str, key: str) -> DataFrame:
    """One row: the share of exact neighbours found, and the least share of any query."""
    hit = exact.select(qid, key).join(found.select(qid, key, F.lit(1).alias("hit")), [qid, key], "left")
    per = hit.groupBy(qid).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return per.agg(F.avg("share").alias("recall"), F.min("share").alias("least"))


def neighbours_ranked(scores: DataFrame, qid: str, key: str) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), key)).cast("long"))
