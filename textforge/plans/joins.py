"""Relational queries: joins, set operations, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.functions import text as tx

from textforge.operators.numbering import numbered

from .registry import Tables, query, sql_query

sql_query("inner_join", "SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id")
sql_query("anti_join", "SELECT d.doc_id, d.source FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", )
sql_query("semi_join", "SELECT d.doc_id, d.source FROM {documents} d LEFT SEMI JOIN {labels} l ON d.doc_id = l.doc_id")
for _name, _kind in (("anti_join", "ANTI"), ("semi_join", "SEMI")):
    from .registry import ORACLE

    ORACLE[_name] = f"SELECT d.doc_id, d.source FROM documents d {_kind} JOIN labels l ON d.doc_id = l.doc_id"
sql_query("left_join_default", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(CAST(l.toxic AS STRING), '') AS toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
sql_query("full_outer_merge", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.v, a.v) AS v FROM (SELECT doc_id, quality AS v FROM {labels} WHERE doc_id % 2 = 0) a FULL OUTER JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic END AS v FROM {labels} WHERE doc_id % 3 = 0) b ON a.doc_id = b.doc_id")
sql_query("first_wins_lookup", "SELECT c.c_custkey, f.o_orderkey FROM {customer} c LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders}) f ON f.o_custkey = c.c_custkey AND f.rn = 1")
sql_query("priority_union", "SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY source_rank, line DESC) AS rn FROM (SELECT o_custkey AS k, o_orderkey AS v, 1 AS source_rank, o_orderkey AS line FROM {orders} WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 2, o_orderkey FROM {orders} WHERE o_orderstatus = 'O') u) x WHERE rn = 1")
sql_query("positional_join", "SELECT a.rn, a.n_name, b.r_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS rn, n_name FROM {nation}) a JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) AS rn, r_name FROM {region}) b ON a.rn = b.rn")
sql_query("groupwise_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) x WHERE rn = 1")
sql_query("bag_except", "SELECT lang, source FROM {documents} EXCEPT ALL SELECT lang, source FROM {documents} WHERE doc_id % 2 = 0")
sql_query("set_intersect", "SELECT source, lang FROM {documents} WHERE doc_id % 2 = 0 INTERSECT SELECT source, lang FROM {documents} WHERE doc_id % 3 = 0")
sql_query("set_except", "SELECT DISTINCT source, lang FROM {documents} EXCEPT SELECT source, lang FROM {documents} WHERE doc_id % 3 <> 0")
sql_query("union_by_name", "SELECT doc_id AS id, source AS label FROM {documents} UNION ALL SELECT vec_id, concat('v', CAST(label AS STRING)) FROM {embeddings}")
sql_query("distinct_union", "SELECT name, min(place) AS place FROM (SELECT lower(n_name) AS name, 1 AS place FROM {nation} UNION ALL SELECT lower(r_name), 2 FROM {region}) x WHERE name NOT IN ('france') GROUP BY name")
sql_query("alias_chain", "WITH RECURSIVE c(id, target, depth) AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE n_nationkey - 1 END, 0 FROM {nation} UNION ALL SELECT c.id, c.target - 1, c.depth + 1 FROM c WHERE c.target % 3 <> 0 AND c.depth < 10) SELECT id, min(target) AS target FROM c GROUP BY id")
sql_query("coverage_thresholds", "SELECT count(*) AS customers, CAST(sum(CASE WHEN best >= 92 THEN 1 ELSE 0 END) AS BIGINT) AS ge_92, CAST(sum(CASE WHEN best >= 82 THEN 1 ELSE 0 END) AS BIGINT) AS ge_82, CAST(sum(CASE WHEN best >= 70 THEN 1 ELSE 0 END) AS BIGINT) AS ge_70 FROM (SELECT o_custkey, max(o_orderkey % 100) AS best FROM {orders} GROUP BY o_custkey) x")
sql_query("group_counts", "SELECT 'lang' AS kind, lang AS value, count(*) AS n FROM {documents} GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM {documents} GROUP BY source")
sql_query("grouping_sets", "SELECT lang, source, count(*) AS n FROM {documents} GROUP BY GROUPING SETS ((), (lang), (source))")
sql_query("having_duplicates", "SELECT count(*) AS n FROM (SELECT c_name, c_nationkey FROM {customer} GROUP BY c_name, c_nationkey HAVING count(*) > 1) x")
sql_query("null_safe_sum", "SELECT coalesce(sum(CASE WHEN quality > 5 THEN quality END), 0) * CAST(1 AS BIGINT) AS total FROM {labels}", )
ORACLE["null_safe_sum"] = "SELECT CAST(coalesce(sum(CASE WHEN quality > 5 THEN quality END), 0) AS BIGINT) AS total FROM labels"
sql_query("substring_filter", "SELECT doc_id, source FROM {documents} WHERE contains(lower(source), 'rc1') AND lang = 'en'")
sql_query("title_search", "SELECT p_partkey, p_name, rank FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY CASE WHEN p_name LIKE 'a%' THEN 0 ELSE 1 END, p_name, p_partkey) AS rank FROM {part} WHERE contains(p_name, 'a')) x WHERE rank <= 12")
sql_query("artist_intent", "SELECT lower(source) AS folded, min(source) AS spelling, count(*) AS n FROM {documents} GROUP BY lower(source) HAVING count(*) >= 2")
sql_query("global_order_topk", "SELECT doc_id, source, n_chars, rank FROM (SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM {documents}) x WHERE rank <= 25")
sql_query("percentiles", "SELECT round({p}, 6) AS p50, round({q}, 6) AS p99 FROM {lineitem}", p=("percentile(l_extendedprice, 0.5)", "quantile_cont(l_extendedprice, 0.5)"), q=("percentile(l_extendedprice, 0.99)", "quantile_cont(l_extendedprice, 0.99)"))
sql_query("upper_median", "SELECT source, n_chars AS median FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM {documents}) x WHERE rn = {half} + 1", half=("n DIV 2", "n // 2"))
sql_query("first_names_joined", "SELECT o_custkey, {agg} AS keys FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM {orders}) x WHERE rn <= 8 GROUP BY o_custkey", agg=("array_join(transform(array_sort(collect_list(struct(rn, o_orderkey))), s -> CAST(s.o_orderkey AS STRING)), '|')", "string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY rn)"))
sql_query("hash_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS STRING), ':7')), doc_id) AS rn FROM {documents}) x WHERE rn <= 40")


sql_query("digest_ids", "SELECT source, count(*) AS n, CAST(sum({part}) AS BIGINT) AS digest FROM {documents} GROUP BY source", part=("CAST(conv(substr(md5(CAST(doc_id AS STRING)), 1, 8), 16, 10) AS BIGINT)", "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)"))


@query("SELECT count(*) AS mismatches FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id FROM documents) a WHERE a.pos <> a.doc_id")
def prefix_guard(t: Tables) -> DataFrame:
    return numbered(t.documents.select("doc_id"), "doc_id").where("number <> doc_id").agg(F.count(F.lit(1)).alias("mismatches"))


@query("SELECT m + row_number() OVER (ORDER BY s_suppkey) AS id, s_name FROM supplier CROSS JOIN (SELECT max(c_custkey) AS m FROM customer) x")
def append_ids(t: Tables) -> DataFrame:
    top = t.customer.agg(F.max("c_custkey").alias("m"))
    return numbered(t.supplier.select("s_suppkey", "s_name"), "s_suppkey").crossJoin(F.broadcast(top)).select((F.col("m") + F.col("number") + 1).alias("id"), "s_name")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id FROM documents WHERE n_chars > 500")
def dense_ids(t: Tables) -> DataFrame:
    return numbered(t.documents.where("n_chars > 500").select("doc_id"), "doc_id").select(F.col("number").alias("id"), "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) x WHERE rn % 4 = 1")
def shard_selection(t: Tables) -> DataFrame:
    return numbered(t.documents.select("doc_id"), "doc_id").where("number % 4 = 1").select("doc_id")


@query("SELECT doc_id, CASE WHEN rn * 10 <= n * 8 THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER () AS n FROM documents) x")
def percent_split(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("key"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return numbered(rows, "key", "doc_id").crossJoin(F.broadcast(n)).select("doc_id", F.when((F.col("number") + 1) * 10 <= F.col("n") * 8, "train").otherwise("test").alias("part"))


WINDOWS = "w AS (SELECT doc_id, i AS win, i * 40 AS a, i * 40 + 80 AS b, (doc_id + i) % 10 AS p FROM (SELECT doc_id, unnest(range(0, CASE WHEN length(text) <= 80 THEN 1 ELSE CAST(ceil((length(text) - 80) / 40.0::DOUBLE) AS BIGINT) + 1 END)) AS i FROM documents)), l AS (SELECT doc_id, line, a, a + n AS b FROM (SELECT doc_id, line, n, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (SELECT doc_id, generate_subscripts(parts, 1) AS line, length(unnest(parts)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))) WHERE n > 0)"


def line_table(t: Tables) -> DataFrame:
    """(doc_id, line, a, b): spans of lines that aren't empty, by a running sum inside the row."""
    lengths = F.transform(tx.lines(F.col("text")), F.length)
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + 1)))
    rows = t.documents.select("doc_id", F.posexplode(F.arrays_zip(lengths.alias("n"), F.slice(starts, F.lit(1), F.size(lengths)).alias("a"))).alias("pos", "s"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.col("s.a").cast("long").alias("a"), (F.col("s.a") + F.col("s.n")).cast("long").alias("b")).where("b > a")


@query(f"WITH {WINDOWS} SELECT doc_id, line, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM l")
def line_spans(t: Tables) -> DataFrame:
    return line_table(t)


@query(f"""WITH {WINDOWS}, o AS (SELECT l.doc_id, l.line, greatest(0, least(w.b, l.b) - greatest(w.a, l.a)) AS weight, p FROM l JOIN w ON w.doc_id = l.doc_id AND w.a < l.b AND l.a < w.b),
g AS (SELECT doc_id, line, sum(weight * p) / (sum(weight) * 10)::DOUBLE AS v FROM o GROUP BY ALL), d AS (SELECT doc_id, sum(p) / (count(*) * 10)::DOUBLE AS mean FROM w GROUP BY doc_id)
SELECT l.doc_id, l.line, round(coalesce(g.v, d.mean), 6) AS score FROM l JOIN d USING (doc_id) LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line""")
def interval_overlap_avg(t: Tables) -> DataFrame:
    """Lines take the average of the windows that overlap them, weighted by overlap; others the document's mean."""
    w, lines, over = overlaps(t)
    best = over.groupBy("doc_id", "line").agg((F.sum(F.col("weight") * F.col("p")) / (F.sum("weight") * 10)).alias("v"))
    means = w.groupBy("doc_id").agg((F.sum("p") / (F.count(F.lit(1)) * 10)).alias("mean"))
    return lines.join(means, "doc_id").join(best, ["doc_id", "line"], "left").select("doc_id", "line", F.round(F.coalesce("v", "mean"), 6).alias("score"))


def overlaps(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of 80 characters, 40 apart, up to the end of each text; lines; and pairs of the two that overlap, each line looking up
    the windows by number."""
    n = F.length("text")
    last = F.when(n <= 80, 0).otherwise(F.ceil((n - 80) / 40)).cast("long")
    w = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i")).select("doc_id", "i", ((F.col("doc_id") + F.col("i")) % 10).alias("p"))
    lines = line_table(t)
    first, end = F.greatest(F.floor((F.col("a") - 80) / 40) + 1, F.lit(0)), F.floor((F.col("b") - 1) / 40)
    each = lines.withColumn("i", F.explode(F.sequence(first, end)))
    weight = F.least(F.col("i") * 40 + 80, F.col("b")) - F.greatest(F.col("i") * 40, F.col("a"))
    return w, lines, each.join(w, ["doc_id", "i"]).withColumn("weight", weight)


@query(f"""WITH {WINDOWS}, o AS (SELECT l.doc_id, l.line, least(w.b, l.b) - greatest(w.a, l.a) AS weight, p FROM l JOIN w ON w.doc_id = l.doc_id AND w.a < l.b AND l.a < w.b)
SELECT doc_id, line, round(avg(p) / 10.0::DOUBLE, 6) AS mean, round(sum(weight * weight * p) / (sum(weight * weight) * 10)::DOUBLE, 6) AS squared, round(sum(CASE WHEN p >= 6 THEN weight ELSE 0 END) / sum(weight)::DOUBLE, 6) AS votes, max(p) AS most FROM o GROUP BY ALL""")
def line_aggregators(t: Tables) -> DataFrame:
    """Four other ways to give lines their windows' values: mean, squared overlap, hard votes, and the largest."""
    _, _, o = overlaps(t)
    w2 = F.col("weight") * F.col("weight")
    return o.groupBy("doc_id", "line").agg(
        F.round(F.avg("p") / 10, 6).alias("mean"), F.round(F.sum(w2 * F.col("p")) / (F.sum(w2) * 10), 6).alias("squared"),
        F.round(F.sum(F.when(F.col("p") >= 6, F.col("weight")).otherwise(0)) / F.sum("weight"), 6).alias("votes"), F.max("p").alias("most"),
    )
