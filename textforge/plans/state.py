"""Queries of state that grows: tails, windows, queues, keys, attempts, stages; and of the health of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.functions import text as tx
from textforge.operators import health as h
from textforge.operators import state as s

from . import queues
from .registry import CORPUS, Tables, query


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0")
def incremental_tail(t: Tables) -> DataFrame:
    digest = F.md5(F.coalesce("text", F.lit("")))
    done = t.documents.where("doc_id % 3 = 0").select("doc_id", digest.alias("digest"))
    rows, same = s.tail(t.documents, done, "doc_id", digest)
    return rows.where(F.lit(same)).select("doc_id", "n_chars")


@query("SELECT vec_id // 4 AS owner, vec_id FROM embeddings WHERE vec_id < 200 UNION ALL SELECT (SELECT max(vec_id // 4) FROM embeddings WHERE vec_id < 200) + 1 + (vec_id - 200) // 2, vec_id FROM embeddings WHERE vec_id >= 200")
def append_windows(t: Tables) -> DataFrame:
    old = t.embeddings.where("vec_id < 200").selectExpr("vec_id DIV 4 AS owner", "vec_id")
    return s.appended(old, t.embeddings.where("vec_id >= 200").selectExpr("(vec_id - 200) DIV 2 AS owner", "vec_id"), "owner")


@query(f"WITH {queues.QUEUE}, m AS (SELECT *, id % 2 = 0 AND owner = '1-URGENT' AND status = 'claimed' AS mine FROM q) SELECT id, CASE WHEN coalesce(mine, false) THEN CASE WHEN attempts < 3 THEN 'new' ELSE 'dead' END ELSE status END AS status, CASE WHEN NOT coalesce(mine, false) THEN owner END AS owner, CASE WHEN NOT coalesce(mine, false) THEN expires END AS expires, attempts, CASE WHEN mine THEN 'timeout' END AS last_error FROM m")
def requeue_failed(t: Tables) -> DataFrame:
    rows = queues.queue(t)
    return s.requeue(rows, rows.where("id % 2 = 0").select("id"), "1-URGENT", F.lit("timeout"))


@query("""WITH w AS (SELECT c_custkey, 'k' || c_custkey AS old, CASE WHEN c_custkey % 5 = 0 THEN 'k' || (c_custkey + 5) WHEN c_custkey % 5 = 1 THEN 'n' || (c_custkey // 10) ELSE NULL END AS want FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY c_custkey) AS rn FROM w) SELECT c_custkey, CASE WHEN ok THEN want ELSE old END AS key, ok AS rekeyed FROM (SELECT *, want IS NOT NULL AND rn = 1 AND NOT EXISTS (SELECT 1 FROM w x WHERE x.old = r.want AND x.c_custkey <> r.c_custkey) AS ok FROM r)""")
def rekey(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.concat(F.lit("k"), "c_custkey").alias("key"))
    new = F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'k' || (c_custkey + 5) WHEN c_custkey % 5 = 1 THEN 'n' || (c_custkey DIV 10) END")
    return s.rekeyed(rows, "c_custkey", "key", new)


@query("SELECT event_id AS id, user_id AS candidate_id, event_type AS stage FROM events WHERE event_id < 100 UNION ALL SELECT 99 + row_number() OVER (ORDER BY user_id, event_type, event_id), user_id, event_type FROM events WHERE event_id BETWEEN 100 AND 120")
def attempt_log(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("candidate_id"), F.col("event_type").alias("stage"))
    return s.logged(rows.where("id < 100"), rows.where("id BETWEEN 100 AND 120").select("candidate_id", "stage"))


@query("SELECT s_suppkey, s_name, NULL::BIGINT AS attempt_count, NULL::VARCHAR AS last_error FROM supplier")
def add_columns(t: Tables) -> DataFrame:
    return s.migrated(t.supplier.select("s_suppkey", "s_name"), {"s_name": "string", "attempt_count": "long", "last_error": "string"})


@query("SELECT DISTINCT k.item_id * 30 AS doc_id, d.doc_id IS NOT NULL AS known, coalesce(trim(d.text) <> '', false) AS has_text FROM benchmark k LEFT JOIN documents d ON d.doc_id = k.item_id * 30")
def point_lookup(t: Tables) -> DataFrame:
    return s.lookup(t.documents.select("doc_id", "text"), t.benchmark.select((F.col("item_id") * 30).alias("doc_id")), "doc_id")


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS place, value > 90 AS good FROM events), g AS (SELECT user_id, min(CASE WHEN good THEN place END) AS hit, max(place) AS last FROM r WHERE place > 0 GROUP BY user_id)
SELECT user_id, (['signup', 'view', 'purchase'])[coalesce(hit, last)] AS stage, CASE WHEN hit IS NOT NULL THEN 'found' ELSE 'missed' END AS outcome, CAST(coalesce(hit, last) AS BIGINT) AS tried FROM g""")
def fetch_cascade(t: Tables) -> DataFrame:
    return s.cascade(t.events.select("user_id", F.col("event_type").alias("stage"), "value"), "user_id", ["signup", "view", "purchase"], F.col("value") > 90)


@query("SELECT page_id AS id, regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '^(\\S+)', 1) AS artist FROM pages WHERE page_id % 3 = 0 AND regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '^(\\S+)', 1) <> ''")
def reparse_artists(t: Tables) -> DataFrame:
    pages = t.pages.select(F.col("page_id").alias("candidate_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("page_title"))
    candidates = t.pages.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 > 0, "known").otherwise(F.when(F.col("page_id") % 2 == 0, " ")).alias("artist"))
    return s.reparse(pages, candidates, F.regexp_extract("page_title", "^(\\S+)", 1))


FACTS = """f AS (SELECT lang AS dataset, count(*) AS n, TIMESTAMP '2024-01-10 00:00:00' + CAST(min(doc_id) * 36 AS BIGINT) * INTERVAL 1 HOUR AS modified, count_if(n_chars < 30) AS failures FROM documents GROUP BY lang),
l AS (SELECT lang AS dataset, count(*) AS was FROM documents WHERE doc_id % 10 <> 0 OR lang = 'de' GROUP BY lang)"""


@query(f"""WITH {FACTS} SELECT dataset, n AS rows, n - was AS delta, round(epoch(TIMESTAMP '2024-01-12 00:00:00' - modified) / 3600, 3) AS age_hours, CASE WHEN failures > 0 THEN 'contract' WHEN n = 0 THEN 'empty' WHEN epoch(TIMESTAMP '2024-01-12 00:00:00' - modified) / 3600 > 24 THEN 'stale' WHEN abs(n - was) > 0.05 * was THEN 'jump' ELSE 'ok' END AS status FROM f LEFT JOIN l USING (dataset)""")
def health_report(t: Tables) -> DataFrame:
    modified = F.to_timestamp(F.lit("2024-01-10 00:00:00")) + F.make_dt_interval(hours=(F.min("doc_id") * 36).cast("int"))
    facts = t.documents.groupBy(F.col("lang").alias("dataset")).agg(F.count(F.lit(1)).alias("rows"), modified.alias("modified"), F.count_if(F.col("n_chars") < 30).alias("failures"))
    last = t.documents.where("doc_id % 10 <> 0 OR lang = 'de'").groupBy(F.col("lang").alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))
    return h.health(facts, last, F.to_timestamp(F.lit("2024-01-12 00:00:00")), 24, 0.05)


@query("SELECT count(*) AS rows, 3 AS columns, min(len(embedding)) AS shortest, max(len(embedding)) AS longest, min(list_min(embedding)) AS low, max(list_max(embedding)) AS high, CAST(sum(len(list_filter(embedding, lambda x: isnan(x)))) AS BIGINT) AS bad FROM embeddings")
def vector_manifest(t: Tables) -> DataFrame:
    return h.describe(t.embeddings, "embedding").select("rows", "columns", F.col("shortest").cast("long").alias("shortest"), F.col("longest").cast("long").alias("longest"), "low", "high", "bad")


@query(f"WITH {CORPUS}, c AS (SELECT song_id, len(regexp_extract_all(lower(coalesce(lyrics, '')), '[\\x{{0900}}-\\x{{097F}}]+|[A-Za-z0-9]+')) AS n, len(string_split(coalesce(lyrics, ''), chr(10))) AS lines, contains(lyrics, '!!') AS flagged FROM corpus) SELECT song_id, CASE WHEN song_id = 7 THEN 'known_bad: garbled' WHEN n < 10 THEN 'too_few_tokens' WHEN lines < 3 THEN 'too_few_lines' ELSE 'artifact_ratio' END AS reason FROM c WHERE song_id = 7 OR n < 10 OR lines < 3 OR flagged")
def quarantine(t: Tables) -> DataFrame:
    _, out = h.rebuild(t.corpus, "song_id", {7: "garbled"}, F.size(tx.tokens(F.col("lyrics"))), F.size(tx.lines(F.col("lyrics"))), F.contains("lyrics", F.lit("!!")))
    return out.select("song_id", "reason")


def scores(t: Tables) -> DataFrame:
    x = (F.col("vec_id") % 12) / 10.0
    return t.embeddings.select(F.when(F.col("vec_id") % 50 > 0, F.col("vec_id")).alias("song_id"), x.alias("joy"), *[(F.col("vec_id") % 10 / 10.0).alias(c) for c in ("sadness", "anger", "fear", "depression", "positive", "negative")], (x - 1).alias("sentiment_score"), F.when(F.col("label") < 8, "positive").otherwise("unsure").alias("sentiment_label"))


@query("""WITH s AS (SELECT CASE WHEN vec_id % 50 > 0 THEN vec_id END AS song_id, (vec_id % 12) / 10.0::DOUBLE AS joy, (vec_id % 12) / 10.0::DOUBLE - 1 AS sentiment_score, CASE WHEN label < 8 THEN 'positive' ELSE 'unsure' END AS sentiment_label FROM embeddings),
f AS (SELECT 'song_id:not_null' AS "check", count_if(song_id IS NULL) AS failures FROM s UNION ALL SELECT 'joy:maximum', count_if(joy > 1) FROM s UNION ALL SELECT 'sentiment_score:maximum', count_if(sentiment_score > 1) FROM s UNION ALL SELECT 'sentiment_label:allowed', count_if(sentiment_label NOT IN ('positive', 'negative', 'neutral')) FROM s
UNION ALL SELECT 'key:unique', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM s GROUP BY song_id HAVING count(*) > 1)) SELECT 'sentiment_scores' AS dataset, "check", failures FROM f WHERE failures > 0""")
def contracts_failed(t: Tables) -> DataFrame:
    found = h.validate_all({"sentiment_scores": scores(t), "mood_labels": None})
    return found.where("failures > 0").select("dataset", "check", "failures")


@query("SELECT song_id, 'joy:maximum' AS checks FROM (SELECT vec_id AS song_id, (vec_id % 12) / 10.0::DOUBLE AS joy, label FROM embeddings WHERE vec_id % 50 > 0) s WHERE joy > 1 AND label < 8")
def bad_score_rows(t: Tables) -> DataFrame:
    rows = h.bad_rows(scores(t).where("song_id IS NOT NULL AND sentiment_label = 'positive'"), h.CONTRACTS["sentiment_scores"])
    return rows.select("song_id", F.array_join("checks", ",").alias("checks"))
