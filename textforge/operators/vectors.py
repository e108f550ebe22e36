"""Vector operators on arrays of doubles, inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0)))


def score_all(queries: DataFrame, items: DataFrame, qid: str, item: str) -> DataFrame:
    """Exact scores of every item for a stated set of queries (columns q and v): every item meets every query.

    The query set is bounded by its caller; Spark broadcasts it only within its own size limit.
    """
    return items.join(queries, F.lit(True)).select(qid, item, dot(F.col("q"), F.col("v")).alias("score"))


def packed(rows: DataFrame, key: str, vector: str, side: str, cell: str | None = None, plus: str | None = None) -> DataFrame:
    """Blocks of rows, one for each Arrow batch, length of vectors and cell: keys, vectors as bytes of doubles, what is added to scores.

    Vectors that are null or have nulls get NaN, for no score.
    """
    kind = rows.schema[key].dataType.simpleString()
    shape = f"{side}_key array<{kind}>, {side}_v binary, {side}_plus binary, cell long, dims long"

    def blocks(batches):
        for batch in batches:
            keys, values, plus_, cells = batch.columns
            size = pc.fill_null(pc.list_value_length(values), -1).to_numpy(zero_copy_only=False)
            cells, plus_ = (x.to_numpy(zero_copy_only=False) for x in (cells, plus_))
            group = np.unique(np.stack([cells, size]), axis=1, return_inverse=True)[1].ravel()
            for g in range(group.max() + 1 if len(group) else 0):
                at = np.flatnonzero(group == g)
                flat = pc.list_flatten(values.take(pa.array(at))).cast("double").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({f"{side}_key": pa.array([keys.take(pa.array(at))], pa.list_(keys.type)), f"{side}_v": [flat.tobytes()], f"{side}_plus": [plus_[at].tobytes()], "cell": [int(cells[at[0]])], "dims": [int(size[at[0]])]})

    one = rows.select(key, vector, (F.col(plus).cast("double") if plus else F.lit(0.0)).alias("__plus"), (F.col(cell).cast("long") if cell else F.lit(0).cast("long")).alias("__cell"))
    return one.where(F.col(key).isNotNull()).mapInArrow(blocks, shape)


def _meet(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of blocks of one cell."""
    return items.withColumnsRenamed({"dims": "x_dims"}).join(queries.withColumnsRenamed({"dims": "q_dims"}), "cell")


def _block(batch: pa.RecordBatch, r: int) -> tuple:
    """Keys of queries and items of a pair of blocks, its products, and what is added to them."""
    at = lambda c: batch.column(c)[r]
    q, x = at("q_key").values, at("x_key").values
    dims = at("q_dims").as_py()
    if dims != at("x_dims").as_py() or dims < 0:
        s = np.full((len(q), len(x)), np.nan)
    else:
        a, b = (np.frombuffer(at(c).as_buffer()).reshape(-1, dims) for c in ("q_v", "x_v"))
        s = a @ b.T
    return q, x, s, np.frombuffer(at("x_plus").as_buffer())


#: Pairs that one task scores, about; and MB of queries that are broadcast.
TASK_PAIRS, BROADCAST_MB = 2_000_000, 16


def half_up(s: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL rounds: halves away from zero, no negative zero."""
    y = s * 10.0**digits
    whole = np.trunc(y)
    with np.errstate(invalid="ignore"):
        whole += np.sign(y) * (np.abs(y - whole) >= 0.5)
    return whole / 10.0**digits + 0.0


def scored_pairs(queries: DataFrame, items: DataFrame, qid: str, item: str, least: float | None = None, change=None) -> DataFrame:
    """As ``score_all``, of blocks multiplied as matrices: (qid, item, score) of all pairs, or of those with ``least`` or more.

    ``change`` gets scores, a row for each query, and the items' keys, and returns the scores that are given out.  Items are dealt
    out to tasks by the number of their pairs; queries are broadcast while they are small, else tasks meet parts of both sides.
    """

    def pairs(batches):
        for batch in batches:
            for r in range(len(batch)):
                q, x, s, _ = _block(batch, r)
                ids = x.to_numpy(zero_copy_only=False)
                for a in range(0, len(q), 100):
                    part = s[a : a + 100] if change is None else change(s[a : a + 100], ids)
                    rows, cols = np.indices(part.shape).reshape(2, -1) if least is None else np.nonzero(part >= least)
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(rows + a)), x.take(pa.array(cols)), pa.array(part[rows, cols], from_pandas=True)], [qid, item, "score"])

    kinds = f"{qid} {queries.schema[qid].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, score double"
    asked, mb = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("q")), F.lit(0)) * 8e-6).first()
    tasks = min(100_000, -(-asked * items.count() // TASK_PAIRS) or 1)
    left, right = packed(items.repartition(tasks), item, "v", "x"), packed(queries.hint("rebalance"), qid, "q", "q")
    both = left.drop("cell").withColumnsRenamed({"dims": "x_dims"}).crossJoin((F.broadcast(right) if mb <= BROADCAST_MB else right).drop("cell").withColumnsRenamed({"dims": "q_dims"}))
    return both.mapInArrow(pairs, kinds)


def nearest(queries: DataFrame, items: DataFrame, qid: str, item: str, k: int, digits: int = 6, others: bool = True, merge: bool = False, weight: float = 1.0, plus: str | None = None, cell: str | None = None) -> DataFrame:
    """(qid, item, score): for each query at least its ``k`` best items by score rounded to ``digits``, then item; whole numbers as keys.

    Exact: each task keeps the best of its items only, so that what is shuffled doesn't grow with pairs; callers rank the rest.
    ``others`` leaves out the item of the query's own id, ``merge`` takes the best of rows with one item; scores are ``weight``
    times the product, and the item's ``plus``.  With ``cell``, queries meet the items of their cells.
    """

    def best(rows, ids, s):
        if merge:
            order = np.lexsort((-s, ids, rows))
            rows, ids, s = rows[order], ids[order], s[order]
            first = np.ones(len(rows), dtype=bool)
            first[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
            rows, ids, s = rows[first], ids[first], s[first]
        order = np.lexsort((ids, -np.round(s, digits), rows))
        rows, ids, s = rows[order], ids[order], s[order]
        start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        keep = rank < k
        return rows[keep], ids[keep], s[keep], rank[keep]

    def out(held):
        for q, rows, ids, s, _ in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(q[rows]), pa.array(ids), pa.array(np.where(np.isneginf(s), np.nan, s), from_pandas=True)], [qid, item, "score"])

    def search(batches):
        held, near = {}, 10.0**-digits
        for batch in batches:
            for r in range(len(batch)):
                q, x, s, more = _block(batch, r)
                q, x = (a.to_numpy(zero_copy_only=False) for a in (q, x))
                if weight != 1.0 or more.any():
                    s *= weight
                    s += more
                if np.isnan(s.max()):
                    s[np.isnan(s)] = -np.inf
                if others:
                    for j in np.flatnonzero(np.isin(x, q)):
                        s[q == x[j], j] = -np.inf
                if merge:
                    order = np.argsort(x, kind="stable")
                    x, start = np.unique(x[order], return_index=True)
                    s = np.maximum.reduceat(s[:, order], start, axis=1)
                name = q.tobytes()
                if name not in held:
                    if len(held) >= 64:
                        yield from out(held)
                        held = {}
                    held[name] = (q, np.zeros(0, int), x[:0], np.zeros(0), np.full(len(q), -np.inf))
                _, rows, ids, kept, cut = held[name]
                i, j = np.nonzero(s >= (cut - near)[:, None])
                crowd = np.flatnonzero(np.bincount(i, minlength=len(q)) > max(4 * k, 64))
                if len(crowd):
                    bound = cut.copy()
                    bound[crowd] = np.maximum(cut[crowd], np.partition(s[crowd], -k, axis=1)[:, -k])
                    some = s[i, j] >= bound[i] - near
                    i, j = i[some], j[some]
                if others:
                    other = q[i] != x[j]
                    i, j = i[other], j[other]
                rows, ids, kept, rank = best(np.r_[rows, i], np.r_[ids, x[j]], np.r_[kept, s[i, j]])
                cut = np.full(len(q), -np.inf)
                cut[rows[rank == k - 1]] = kept[rank == k - 1]
                held[name] = (q, rows, ids, kept, cut)
        yield from out(held)

    kinds = f"{qid} {queries.schema[qid].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, score double"
    spread = queries.repartition(cell) if cell else queries.hint("rebalance")
    return _meet(packed(spread, qid, "q", "q", cell), packed(items, item, "v", "x", cell, plus)).mapInArrow(search, kinds)


def mean_vectors(rows: DataFrame, owner: str, vector: str) -> DataFrame:
    """The mean vector of each owner: positions are averaged one by one, so a hot owner is aggregated map-side."""
    parts = rows.select(owner, F.posexplode(vector).alias("pos", "x")).groupBy(owner, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def max_similarity(scores: DataFrame, query: str, window: str, owner: Column) -> DataFrame:
    """Best window of each owner; owners without windows have no row."""
    return scores.withColumn("owner", owner).groupBy(query, "owner").agg(F.max("score").alias("score"))


def features(rows: DataFrame, key: str, vector: str, sentiment: str, category: str, artist: str, categories: list, weights: tuple[float, float] = (0.3, 0.2)) -> DataFrame:
    """Unit vector, scaled sentiment, one-hot category (sorted) and artist frequency in one array."""
    ws, wm = weights
    count = F.count(F.lit(1)).over(Window.partitionBy(artist))
    most = rows.groupBy(artist).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    hot = F.array(*[F.when(F.col(category) == c, F.lit(wm)).otherwise(F.lit(0.0)) for c in categories])
    rows = rows.withColumn("n", count).crossJoin(F.broadcast(most))
    return rows.select(key, F.concat(unit(F.col(vector)), F.array((F.col(sentiment) + 1) / 2 * ws), hot, F.array(F.col("n") / F.col("most") * wm)).alias("features"))
