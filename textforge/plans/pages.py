"""Queries over web pages and lines of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.functions import text as tx
from textforge.sources import adapters, html
from textforge.sources.files import locations

from .registry import Tables, query, sql_query

sql_query("title_extract", "SELECT page_id, {one}, 1) AS title FROM {pages}", one=("regexp_extract(html, '<title>([^<]*)</title>'", "regexp_extract(html, '<title>([^<]*)</title>'"))
sql_query("url_host_filter", "SELECT page_id, host FROM (SELECT page_id, {host} AS host FROM {pages}) x WHERE host LIKE '%.org' AND host NOT LIKE '%casino%'", host=("parse_url(url, 'HOST')", "regexp_extract(url, '^https?://([^/?#:]+)', 1)"))
sql_query("link_discovery", "SELECT DISTINCT href FROM (SELECT {each} AS href FROM {pages}) x", each=("explode(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))", "unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))"))
sql_query("sha_keys", "SELECT page_id, concat('A-', substr({sha}, 1, 10)) AS key FROM {pages}", sha=("sha1(url)", "sha1(url)"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(?:script|style|head)[^>]*>.*?</(?:script|style|head)>', '', 'g'), '<br */?>|</?(?:p|div|li|h1|nav|article|footer|ul)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM a) SELECT page_id, CAST(len(l) AS BIGINT) AS n_lines, array_to_string(l, chr(10)) AS text FROM l""")
def page_text(t: Tables) -> DataFrame:
    lines = html.content_lines(F.col("html"))
    return t.pages.select("page_id", F.size(lines).cast("long").alias("n_lines"), F.array_join(lines, "\n").alias("text"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'devanagari' WHEN regexp_matches(text, '[A-Za-z]') THEN 'romanized' ELSE 'unknown' END AS script FROM documents")
def script_class(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.script(F.col("text")).alias("script"))


@query("SELECT doc_id, round(CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 0 END, 6) AS ratio FROM (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS k FROM documents)")
def script_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(tx.letter_ratio(F.col("text"), "A-Za-z"), 6).alias("ratio"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) SELECT doc_id, line, min(pos) AS first_pos, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY doc_id, line")
def first_occurrence_lines(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("pos", "line")).where(F.trim("line") != "")
    return rows.groupBy("doc_id", "line").agg(F.min("pos").cast("long").alias("first_pos"), F.count(F.lit(1)).alias("n"))


NOISE = "(?:https?://|www\\.|@[a-z]|!!|\\|)"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count_if(trim(line) <> '' AND (regexp_matches(line, '{NOISE}') OR len(regexp_extract_all(line, '[0-9]')) >= 8))::BIGINT AS noise_lines, count(*) AS n_lines FROM l GROUP BY doc_id""")
def noise_lines(t: Tables) -> DataFrame:
    lines = tx.lines(F.col("text"))
    bad = F.filter(lines, lambda x: (F.trim(x) != "") & (x.rlike(NOISE) | (F.regexp_count(x, F.lit("[0-9]")) >= 8)))
    return t.documents.select("doc_id", F.size(bad).cast("long").alias("noise_lines"), F.size(lines).cast("long").alias("n_lines"))


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, 'https?://[^ ]+|[A-Za-z0-9._]+@[A-Za-z0-9.]+', '', 'g'), '[ \\t]+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '{NOISE}')), chr(10)) AS body FROM documents""")
def clean_body(t: Tables) -> DataFrame:
    stripped = F.transform(tx.lines(F.col("text")), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "https?://[^ ]+|[A-Za-z0-9._]+@[A-Za-z0-9.]+", ""), "[ \\t]+", " ")))
    return t.documents.select("doc_id", F.array_join(F.filter(stripped, lambda x: (x != "") & ~x.rlike(NOISE)), "\n").alias("body"))


@query("SELECT doc_id, CASE WHEN length(text) < 120 THEN 'too_short' WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'ok' WHEN len(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: x IN ('the', 'de', 'und', 'la'))) >= 2 THEN 'ok' ELSE 'script_rejected' END AS verdict FROM documents")
def acceptance(t: Tables) -> DataFrame:
    hits = F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)), lambda x: x.isin("the", "de", "und", "la")))
    verdict = F.when(F.length("text") < 120, "too_short").when(F.col("text").rlike("[\\x{0900}-\\x{097F}]"), "ok").when(hits >= 2, "ok").otherwise("script_rejected")
    return t.documents.select("doc_id", verdict.alias("verdict"))


@query("SELECT page_id, coalesce(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '') LIKE '%.org' AND contains(url, '/') AND NOT contains(lower(url), 'casino') AS allowed FROM pages")
def allowed_urls(t: Tables) -> DataFrame:
    hosts = [r.h for r in t.pages.select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("h")).where("h LIKE '%.org' AND h NOT LIKE '%casino%'").distinct().limit(1000).collect()]
    return t.pages.select("page_id", adapters.allowed(F.col("url"), hosts, "/", ["casino"]).alias("allowed"))


@query()
def site_titles(t: Tables) -> DataFrame:
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    kinds = F.when(F.col("page_id") % 4 == 0, F.concat(raw, F.lit(" Lyrics by Some One"))).when(F.col("page_id") % 4 == 1, F.concat(raw, F.lit(" | Some One | Site"))).when(F.col("page_id") % 4 == 2, F.concat(raw, F.lit(" - Lyrics"))).otherwise(raw)
    return t.pages.select("page_id", adapters.title_artist(kinds).alias("x"), adapters.slug_title(F.col("url")).alias("slug")).select("page_id", "x.title", "x.artist", "slug")


@query("SELECT array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(html, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1), regexp_extract_all(html, 'href=[\"'']([^\"''#]+)', 1)))), ' ') AS links, page_id FROM pages")
def page_locations(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(locations(F.col("html")), " ").alias("links"))
