"""Queries of the asset graph and of resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.operators import assets

from .registry import Tables, query, sql_query

EDGES = "SELECT n_nationkey AS child, n_nationkey - 1 - n_regionkey AS parent FROM {nation} WHERE n_nationkey - 1 - n_regionkey >= 0"
sql_query("asset_reach", f"WITH RECURSIVE e AS ({EDGES}), r(root, node, depth) AS (SELECT parent, child, 1 FROM e UNION ALL SELECT r.root, e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.node WHERE r.depth < 25) SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY root, node")
sql_query("last_runs", "SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_purchase, count(*) AS runs FROM {events} GROUP BY user_id")


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    """The mean difference of quality and toxicity over labelled documents, with its interval over 2,000 paired resamples."""
    return assets.paired_bootstrap(t.labels.select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("x")), "doc_id")


@query()
def asset_toposort(t: Tables) -> DataFrame:
    """The graph is a list of steps, bounded by what people define."""
    rows = t.nation.select(F.col("n_nationkey").alias("child"), (F.col("n_nationkey") - 1 - F.col("n_regionkey")).alias("parent"))
    graph = {str(r.child): [str(r.parent)] if r.parent >= 0 else [] for r in rows.collect()}
    return t.spark.createDataFrame(list(enumerate(assets.topological(graph))), "place long, asset string")
