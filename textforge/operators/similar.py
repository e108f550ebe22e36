"""Similarity joins that find all pairs without comparing all: cells around pivots, bands of MinHash signatures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .fuzzy import grams
from .vectors import dot, scored_pairs, unit


def cosine_links(rows: DataFrame, key: str, vector: str, least: float, pivots: int = 16, blocks: int = 8) -> DataFrame:
    """(a, b, score), a < b, of all pairs with a cosine of ``least`` or more.

    A vector's home is the cell of its nearest pivot; it visits every cell whose pivot is farther by no more than twice the angle
    asked for, where by the triangle inequality all its partners have their homes.  Cells are dealt out in blocks of home
    rows, so that a large one is spread over tasks.  The pivots, the rows of smallest hash, are a list of fixed length.
    Beyond a right angle cells leave out next to nothing, so that all pairs are multiplied in blocks.
    """
    reach = 2 * math.acos(least) + 1e-6
    unit_rows = rows.select(F.col(key).alias("k"), unit(F.col(vector)).alias("v"))
    if reach > math.pi / 2:
        both = scored_pairs(unit_rows.select(F.col("k").alias("a"), F.col("v").alias("q")), unit_rows.select(F.col("k").alias("b"), "v"), "a", "b", least)
        return both.where("a < b").groupBy("a", "b").agg(F.max("score").alias("score"))
    chosen = unit_rows.orderBy(F.md5(F.col("k").cast("string")), "k").limit(pivots).select(F.col("k").alias("p"), F.col("v").alias("pv"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("v"), F.col("pv")))))
    far = unit_rows.join(F.broadcast(chosen), F.lit(True)).select("k", "v", F.struct(angle.alias("d"), "p").alias("at"))
    cells = far.groupBy("k").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("at")).alias("cells"))
    home = cells.select(F.col("k").alias("a"), F.col("v").alias("x"), F.col("cells")[0]["p"].alias("cell"), F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("block"))
    near = F.filter("cells", lambda c: c["d"] <= F.col("cells")[0]["d"] + reach)
    visit = cells.select(F.col("k").alias("b"), F.col("v").alias("y"), F.explode(F.transform(near, lambda c: c["p"])).alias("cell")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = home.join(visit, ["cell", "block"]).withColumn("score", dot(F.col("x"), F.col("y"))).where((F.col("score") >= least) & (F.col("a") != F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def cosine_groups(rows: DataFrame, key: str, vector: str, copies: str, least: float, block: int = 4096) -> DataFrame:
    """(node, far, low) for each vector and each block where it has links at a cosine of ``least`` or more: their number, counted by the
    other's ``copies``, and the smallest node that links of these two blocks reach.  Whole numbers as keys.

    All pairs are multiplied, a task holding two blocks; a link isn't a row, so that what leaves a task grows with its vectors, however
    many are alike.  Null vectors and those with nulls have no links, nor have vectors of different lengths.
    """
    valid = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    parts = max(2, math.ceil(valid.count() / block))
    kind = np.float32 if "float" in rows.schema[vector].dataType.simpleString() else np.float64
    sides = valid.select(F.col(key).cast("long").alias("k"), F.col(copies).cast("long").alias("n"), F.col(vector).alias("v"), F.size(vector).alias("dims"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("block"))

    def pack(t: pa.Table) -> pa.Table:
        flat = t["v"].combine_chunks().flatten().cast("double").to_numpy(zero_copy_only=False)
        return pa.table({"dims": t["dims"][:1], "block": t["block"][:1], "k": pa.array([t["k"].to_numpy()]), "n": pa.array([t["n"].to_numpy()]), "v": pa.array([flat.astype(kind).tobytes()], pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        i, j, dims = (t[c][0].as_py() for c in ("i", "j", "dims"))
        none = {"node": pa.array([], pa.int64()), "far": pa.array([], pa.int64()), "low": pa.array([], pa.int64())}
        if i != j and len(t) == 1:  # the other block has no vectors of this length
            return pa.table(none)
        k, n = (np.concatenate([x.values.to_numpy() for x in t[c]]) for c in ("k", "n"))
        v = np.concatenate([np.frombuffer(x.as_buffer(), kind).reshape(len(y.values), dims) for x, y in zip(t["v"], t["k"], strict=True)]).astype(float)
        cut = len(t["k"][0].values) if i != j else 0  # places before it meet those from it on
        length = np.sqrt((v * v).sum(axis=1))
        unit_v = v / np.where(length > 0, length, 1.0)[:, None]
        place = np.argsort(np.argsort(k, kind="stable"), kind="stable")  # places in the order of nodes
        parent, far = np.arange(len(k)), np.zeros(len(k))
        for a in range(0, cut or len(k), 256):
            b = min(a + 256, cut or len(k))
            s = unit_v[a:b] @ unit_v[cut:].T
            r, c = np.nonzero(s >= least - 1e-9)
            s, r, c = s[r, c], r + a, c + cut
            near = np.flatnonzero(s <= least + 1e-9)
            for e in (near[x : x + 10_000] for x in range(0, len(near), 10_000)):  # on the edge: summed up and divided as SQL does it
                dot_ = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
                x, y = v[r[e]], v[c[e]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    s[e] = dot_(x, y) / np.sqrt(dot_(x, x) * dot_(y, y))
            hit = (s >= least) & (r != c)
            r, c = r[hit], c[hit]
            far += np.bincount(r, n[c], len(k))
            if i != j:
                far += np.bincount(c, n[r], len(k))
            graph.join(parent, place[r], place[c])
        some = np.flatnonzero(far)
        return pa.table({"node": k[some], "far": far[some].astype(np.int64), "low": np.sort(k)[parent[place[some]]]})

    packs = sides.groupBy("dims", "block").applyInArrow(pack, "dims int, block int, k array<long>, n array<long>, v binary")
    both = packs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = both.select("dims", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "k", "n", "v")
    return both.repartition(min(4096, parts * (parts + 1) // 2), "dims", "i", "j").groupBy("dims", "i", "j").applyInArrow(meet, "node long, far long, low long")


def minhash_pairs(rows: DataFrame, key: str, text: str, gram: int, least: float, bands: int = 24, width: int = 3) -> DataFrame:
    """(a, b, jaccard), a < b, of pairs of distinct texts that share a band of MinHash values and are as alike as ``least``.

    At a similarity of 0.6 a pair shares one of 24 bands of 3 values with a probability of 0.997.  Texts that are equal are
    compared once; the pairs of one band's key are those of its distinct texts.
    """
    texts = rows.groupBy(F.col(text).alias("t")).agg(F.min(key).alias("k")).withColumn("g", grams(F.col("t"), gram))
    value = lambda i: F.array_min(F.transform("g", lambda x: F.xxhash64(x, F.lit(i))))
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[value(b * width + j) for j in range(width)]).alias("h")) for b in range(bands)])
    banded = texts.select("k", "g", F.explode(keys).alias("key")).select("k", "g", "key.band", "key.h")
    left, right = banded.select(F.col("k").alias("a"), F.col("g").alias("x"), "band", "h"), banded.select(F.col("k").alias("b"), F.col("g").alias("y"), "band", "h")
    both = left.join(right, ["band", "h"]).where("a < b").withColumn("n", F.size(F.array_intersect("x", "y")))
    pairs = both.withColumn("jaccard", F.col("n") / (F.size("x") + F.size("y") - F.col("n"))).where(F.col("jaccard") >= least)
    return pairs.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
