"""Queries of prompts, replies, metrics and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.operators import exchange

from .registry import CORPUS, Tables, query

BLOCK = "Tell the mood of every item below."


@query(f"""WITH {CORPUS}, e AS (SELECT song_id // 10 AS batch, song_id, '[item ' || song_id || ']' || chr(10) || 'title: ' || title || chr(10) || 'by: ' || coalesce(artist, '') || chr(10) || substr(coalesce(lyrics, ''), 1, 3000) || chr(10) || '[end]' AS entry FROM corpus)
SELECT batch, CAST(count(*) AS BIGINT) AS songs, md5('{BLOCK}' || chr(10) || chr(10) || 'Items' || chr(10) || string_agg(entry, chr(10) ORDER BY song_id) || chr(10) || chr(10) || 'Return one JSON list with an object for each of the ' || count(*) || ' items, and nothing else.') AS prompt_md5
FROM e GROUP BY batch""")
def label_prompts(t: Tables) -> DataFrame:
    rows = exchange.prompts(t.corpus, F.expr("song_id div 10"), BLOCK)
    return rows.select("batch", F.col("songs").cast("long").alias("songs"), F.md5("prompt").alias("prompt_md5"))


@query("SELECT doc_id AS song_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM labels JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id)")
def label_replies(t: Tables) -> DataFrame:
    item = F.struct(
        F.col("doc_id").cast("string").alias("song_id"), (F.col("quality") == 1).alias("quality"), F.col("toxic").alias("toxic"),
        F.when(F.col("doc_id") % 3 == 0, "HIGH").otherwise("unsure").alias("confidence"),
    )
    sheets = t.labels.groupBy(F.expr("doc_id div 20").alias("batch")).agg(F.concat(F.lit("Here it is:\n"), F.to_json(F.collect_list(item)), F.lit("\nDone.")).alias("reply"))
    rows = exchange.replies(sheets, t.documents.select(F.col("doc_id").alias("song_id")).distinct(), ["quality", "toxic"])
    return rows.select("song_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"), "confidence")


@query("""SELECT 'events_total' AS name, 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type
UNION ALL SELECT 'documents_total', 'documents_total ' || count(*) FROM documents""")
def metric_text(t: Tables) -> DataFrame:
    events = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))
    events = events.select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), "event_type").alias("labels"), "value")
    documents = t.documents.agg(F.count(F.lit(1)).alias("value"))
    empty = F.lit(None).cast("map<string,string>").alias("labels")
    return exchange.metric_lines(events.unionByName(documents.select(F.lit("documents_total").alias("name"), empty, "value")))


@query("SELECT doc_id, lang FROM documents ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42') LIMIT 25")
def reservoir_sample(t: Tables) -> DataFrame:
    return exchange.seeded_sample(t.documents.select("doc_id", "lang"), "doc_id", 25)
