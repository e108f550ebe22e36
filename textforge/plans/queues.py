"""Queries of queue transitions, on orders as a work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.operators import queues as q

from .registry import Tables, query, sql_query

QUEUE = """q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'claimed' ELSE 'done' END AS status, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS owner,
CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + CAST(o_orderkey % 40 AS BIGINT) * INTERVAL 1 MINUTE END AS expires, CAST(o_orderkey % 4 AS BIGINT) AS attempts FROM orders)"""



def queue(t: Tables) -> DataFrame:
    base = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    status = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "P", "claimed").otherwise("done")
    claimed = F.col("o_orderstatus") == "P"
    expires = F.when(claimed & (F.col("o_orderkey") % 3 > 0), base + F.make_dt_interval(mins=(F.col("o_orderkey") % 40).cast("int")))
    return t.orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.when(claimed, F.col("o_orderpriority")).alias("owner"), expires.alias("expires"), (F.col("o_orderkey") % 4).cast("long").alias("attempts"))


def now():
    return F.to_timestamp_ntz(F.lit("2024-01-01 00:20:00"))


@query(f"""WITH {QUEUE}, f AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM q WHERE status = 'new' AND attempts < 3)
SELECT q.id, CASE WHEN f.rn <= 50 THEN 'claimed' ELSE status END AS status, CASE WHEN f.rn <= 50 THEN 'w1' ELSE owner END AS owner, CASE WHEN f.rn <= 50 THEN TIMESTAMP '2024-01-01 00:30:00' ELSE expires END AS expires,
attempts + CASE WHEN f.rn <= 50 THEN 1 ELSE 0 END AS attempts FROM q LEFT JOIN f USING (id)""")
def claim_batch(t: Tables) -> DataFrame:
    return q.claim(queue(t), "w1", 50, now())


@query(f"""WITH {QUEUE}, l AS (SELECT *, status = 'claimed' AND (expires IS NULL OR expires < TIMESTAMP '2024-01-01 00:20:00') AS lost FROM q)
SELECT id, CASE WHEN lost THEN 'new' ELSE status END AS status, CASE WHEN NOT lost THEN owner END AS owner, CASE WHEN NOT lost THEN expires END AS expires, attempts FROM l""")
def reset_orphans(t: Tables) -> DataFrame:
    return q.reset_orphans(queue(t), now())


@query(f"WITH {QUEUE} SELECT id, CASE WHEN status IN ('new', 'failed') AND attempts >= 3 THEN 'dead' ELSE status END AS status, owner, expires, attempts FROM q")
def sweep_exhausted(t: Tables) -> DataFrame:
    return q.sweep(queue(t))


@query(f"WITH {QUEUE} SELECT id, attempts FROM q WHERE status = 'new' AND attempts >= 3")
def dead_letters(t: Tables) -> DataFrame:
    return q.sweep(queue(t)).where("status = 'dead'").select("id", "attempts")


@query(f"WITH {QUEUE} SELECT id, CASE WHEN id % 2 = 0 AND owner = '1-URGENT' THEN CASE WHEN attempts < 3 THEN 'new' ELSE 'dead' END ELSE status END AS status, attempts FROM q")
def finish_failed(t: Tables) -> DataFrame:
    rows = queue(t)
    return q.finish(rows, rows.where("id % 2 = 0").select("id"), "1-URGENT", "failed").select("id", "status", "attempts")


@query(f"WITH {QUEUE}, k AS (SELECT id, attempts, row_number() OVER (ORDER BY id) AS rn FROM q WHERE status = 'new' AND attempts < 3) SELECT id, attempts FROM k WHERE rn <= 20")
def next_batch(t: Tables) -> DataFrame:
    return queue(t).where("status = 'new' AND attempts < 3").orderBy("id").limit(20).select("id", "attempts")


@query("WITH n AS (SELECT o_custkey % 1600 AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey % 1600 ORDER BY o_orderkey DESC) AS rn FROM orders) SELECT k, v FROM n WHERE rn = 1 UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT k FROM n)")
def upsert(t: Tables) -> DataFrame:
    new = t.orders.select((F.col("o_custkey") % 1600).alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("at"))
    return q.upsert(t.customer.select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("v")), new, "k", "at")


@query("WITH n AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders GROUP BY o_custkey) SELECT k, v FROM n WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def insert_ignore(t: Tables) -> DataFrame:
    new = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return q.insert_ignore(t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), new, "k", "v")


@query("SELECT d.doc_id, d.source, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.n_chars END, l.quality) AS n FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_if_null(t: Tables) -> DataFrame:
    base = t.documents.select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("n"))
    return q.fill_nulls(base, t.labels.select("doc_id", F.col("quality").cast("long").alias("n")), "doc_id", ["n"])


@query("SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC) > 5 AS stale FROM (SELECT DISTINCT o_orderdate FROM orders)")
def snapshot_retention(t: Tables) -> DataFrame:
    return q.keep_newest(t.orders.select("o_orderdate").distinct(), "o_orderdate", 5)
