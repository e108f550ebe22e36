"""Queries of contracts, budgets, audits and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.functions import text as tx
from textforge.operators import metrics as m
from textforge.operators import quality as q

from .registry import Tables, query, sql_query

LABELS = q.Contract("labels", {"doc_id": q.Field("int", nullable=False, least=0), "quality": q.Field("int", nullable=False, allowed=(0, 1)), "toxic": q.Field("int", allowed=(0,)), "note": q.Field("str")}, key=("doc_id",))


@query("""SELECT unnest(['doc_id:not_null', 'doc_id:numeric', 'doc_id:integral', 'doc_id:minimum', 'quality:not_null', 'quality:numeric', 'quality:integral', 'quality:allowed', 'toxic:numeric', 'toxic:integral', 'toxic:allowed', 'key:unique', 'columns:missing', 'columns:extra']) AS "check",
unnest([count_if(doc_id IS NULL), 0, 0, count_if(doc_id < 0), count_if(quality IS NULL), 0, 0, count_if(quality NOT IN (0, 1)), 0, 0, count_if(toxic NOT IN (0)), (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM labels GROUP BY doc_id HAVING count(*) > 1)), 1, 0])::BIGINT AS failures FROM labels""")
def contract_report(t: Tables) -> DataFrame:
    return q.validate(t.labels, LABELS).select("check", "failures")


@query("""WITH m AS (SELECT unnest(['rows', 'empty_share', 'sources', 'coverage']) AS metric, unnest([count(*)::DOUBLE, avg(CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 0 END), count(DISTINCT source)::DOUBLE, (SELECT count(*) FROM labels) / count(*)::DOUBLE]) AS value FROM documents)
SELECT l.metric, round(value, 6) AS value, value IS NOT NULL AND (least_value IS NULL OR value >= least_value) AND (most_value IS NULL OR value <= most_value) AS ok
FROM (VALUES ('rows', 100.0, NULL), ('empty_share', NULL, 0.01), ('sources', 2.0, 100.0), ('coverage', 0.9, NULL), ('unknown', 0.0, NULL)) l(metric, least_value, most_value) LEFT JOIN m USING (metric)""")
def budget_checks(t: Tables) -> DataFrame:
    n = t.labels.agg(F.count(F.lit(1)).alias("labels"))
    one = t.documents.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.trim(F.coalesce("text", F.lit(""))) == "").cast("int")).alias("empty_share"), F.countDistinct("source").alias("sources")).crossJoin(n)
    values = F.explode(F.create_map(F.lit("rows"), F.col("rows").cast("double"), F.lit("empty_share"), F.col("empty_share"), F.lit("sources"), F.col("sources").cast("double"), F.lit("coverage"), F.col("labels") / F.col("rows")))
    rows = q.budgets(one.select(values.alias("metric", "value")), [("rows", 100.0, None), ("empty_share", None, 0.01), ("sources", 2.0, 100.0), ("coverage", 0.9, None), ("unknown", 0.0, None)])
    return rows.withColumn("value", F.round("value", 6))


@query("WITH l AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT line, count(*) AS n FROM l WHERE length(line) >= 12 GROUP BY line HAVING count(*) >= 4")
def shared_templates(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode(tx.lines(F.col("text"))).alias("line")).select("doc_id", F.trim("line").alias("line")).where(F.length("line") >= 12).distinct()
    return rows.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")


#: Line artifacts by name.
ARTIFACTS = {"url": "https?://|www\\.", "mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "digits": "[0-9]{3,}", "table": "\\|", "shout": "!!", "license": "(?i)license|copyright"}


@query(f"""WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
f AS (SELECT doc_id, source, {" OR ".join(f"regexp_matches(line, '{p}')" for p in ARTIFACTS.values())} AS bad FROM l WHERE trim(line) <> '')
SELECT doc_id, source, count(*) AS n_lines, count_if(bad)::BIGINT AS artifact_lines, round(count_if(bad) / count(*)::DOUBLE, 6) AS ratio, count_if(bad) / count(*)::DOUBLE >= 0.5 AS quarantine FROM f GROUP BY ALL""")
def artifact_scan(t: Tables) -> DataFrame:
    lines = F.filter(tx.lines(F.col("text")), lambda x: F.trim(x) != "")
    bad = F.filter(lines, lambda x: x.rlike("|".join(f"(?:{p})" for p in ARTIFACTS.values() if not p.startswith("(?i)")) + "|(?i:license|copyright)"))
    n, k = F.size(lines).cast("long"), F.size(bad).cast("long")
    rows = t.documents.select("doc_id", "source", n.alias("n_lines"), k.alias("artifact_lines")).where("n_lines > 0")
    ratio = F.col("artifact_lines") / F.col("n_lines")
    return rows.select("doc_id", "source", "n_lines", "artifact_lines", F.round(ratio, 6).alias("ratio"), (ratio >= 0.5).alias("quarantine"))


@query(f"""WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
SELECT name, count_if(hit)::BIGINT AS n FROM (SELECT unnest([{", ".join(f"'{n}'" for n in ARTIFACTS)}]) AS name, unnest([{", ".join(f"regexp_matches(line, '{p}')" for p in ARTIFACTS.values())}]) AS hit FROM l) GROUP BY name""")
def artifact_families(t: Tables) -> DataFrame:
    rows = t.documents.select(F.explode(tx.lines(F.col("text"))).alias("line"))
    one = rows.agg(*[F.count_if(F.col("line").rlike(p)).alias(n) for n, p in ARTIFACTS.items()])
    return one.unpivot([], list(ARTIFACTS), "name", "n")


sql_query("per_source_rollup", "SELECT source, count(*) AS songs, CAST(sum(CASE WHEN n_chars < 100 THEN 1 ELSE 0 END) AS BIGINT) AS short_songs, CAST(sum(n_chars) AS BIGINT) AS chars, round(sum(CASE WHEN n_chars < 100 THEN n_chars ELSE 0 END) / CAST(greatest(sum(n_chars), 1) AS DOUBLE), 4) AS ratio FROM {documents} GROUP BY source")
sql_query("share_metrics", "SELECT avg(CASE WHEN n > 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS duplicate_share, min(length(text)) * CAST(1 AS BIGINT) AS shortest, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM (SELECT text, source, lang, count(*) OVER (PARTITION BY text) AS n FROM {documents}) x")
sql_query(
    "manifest_checks",
    "SELECT 'documents' AS name, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high, count(*) = count(DISTINCT doc_id) AS is_unique, count(*) = max(doc_id) - min(doc_id) + 1 AS is_dense FROM {documents} UNION ALL "
    "SELECT 'labels', count(*), min(doc_id), max(doc_id), count(*) = count(DISTINCT doc_id), count(*) = max(doc_id) - min(doc_id) + 1 FROM {labels} UNION ALL SELECT 'pages', count(*), min(page_id), max(page_id), count(*) = count(DISTINCT page_id), count(*) = max(page_id) - min(page_id) + 1 FROM {pages}",
)
sql_query("row_deltas", "SELECT month, n, n - lag(n) OVER (ORDER BY month) AS delta FROM (SELECT {month} AS month, count(*) AS n FROM {lineitem} GROUP BY 1) x", month=("date_format(l_shipdate, 'yyyy-MM')", "strftime(l_shipdate, '%Y-%m')"))
sql_query("gold_class_counts", "SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'mixed' WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS gold, count(*) AS n FROM {labels} GROUP BY 1")
sql_query("relaxed_accuracy", "SELECT round(avg(CASE WHEN (quality = 1 AND toxic = 1) OR (guess = 'positive' AND quality = 1) OR (guess = 'negative' AND toxic = 1) OR (guess = 'neutral' AND quality = 0 AND toxic = 0) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS accuracy, count(*) AS n FROM (SELECT l.*, CASE WHEN n_chars > 1500 THEN 'positive' WHEN n_chars < 300 THEN 'negative' ELSE 'neutral' END AS guess FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id) x")


@query("""WITH x AS (SELECT quality = 1 AS y, n_chars > 600 AS g FROM labels JOIN documents USING (doc_id)), c AS (SELECT count_if(y AND g)::BIGINT AS tp, count_if(NOT y AND g)::BIGINT AS fp, count_if(y AND NOT g)::BIGINT AS fn FROM x)
SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1 FROM c""")
def confusion_f1(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id")
    return rows.agg(*m.f1(F.col("quality") == 1, F.col("n_chars") > 600))


@query("SELECT round(sum(levenshtein(a, b)) / sum(greatest(length(b), 1))::DOUBLE, 6) AS cer, round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 6) AS exact, count(*) AS n FROM (SELECT p_name AS b, replace(p_name, 'e', 'i') AS a FROM part)")
def cer_micro(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_name").alias("b"), F.replace("p_name", F.lit("e"), F.lit("i")).alias("a"))
    return rows.agg(*m.character_error("a", "b"))
