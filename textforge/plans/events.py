"""Queries over the event store: validation, retention and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.operators import events as e

from .registry import Tables, query, sql_query


@query("""SELECT event_id, CASE WHEN event_type IS NULL OR event_type NOT IN ('signup', 'purchase', 'view', 'click') THEN 'event_type' WHEN ts IS NULL THEN 'timestamp' WHEN ts > TIMESTAMP '2024-01-25 00:05:00' THEN 'future'
  WHEN user_id IS NULL OR length(CAST(user_id AS VARCHAR)) > 64 THEN 'user_id' WHEN value < 0 THEN 'value' WHEN strlen(props) > 4096 THEN 'metadata_size' WHEN json_type(props) <> 'OBJECT' THEN 'metadata' END AS reason FROM events""")
def event_validate(t: Tables) -> DataFrame:
    return t.events.select("event_id", e.reason(["signup", "purchase", "view", "click"], "2024-01-25 00:00:00").alias("reason"))


sql_query("event_stats", "SELECT event_type, count(*) AS n, max(ts) AS latest, CAST(sum(CASE WHEN ts >= TIMESTAMP{ntz} '2024-01-30 00:00:00' THEN 1 ELSE 0 END) AS BIGINT) AS last_day FROM {events} GROUP BY event_type", ntz=("_NTZ", ""))
sql_query("retention", "SELECT event_id FROM {events} WHERE ts >= TIMESTAMP{ntz} '2024-01-20 00:00:00'", ntz=("_NTZ", ""))
sql_query("json_props", "SELECT event_id, CAST({get} AS BIGINT) AS k FROM {events}", get=("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling(t: Tables) -> DataFrame:
    return e.windowed(t.events, "5 minutes", None).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) - CAST(i AS BIGINT) * INTERVAL 5 MINUTE AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, range(0, 6) r(i) GROUP BY ALL")
def sliding(t: Tables) -> DataFrame:
    return e.windowed(t.events, "30 minutes", "5 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sess""")
def session(t: Tables) -> DataFrame:
    return e.sessions(t.events, "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


sql_query("dedup_events", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS rn FROM (SELECT event_id, user_id, ts FROM {events} UNION ALL SELECT event_id, user_id, ts FROM {events} WHERE event_id % 10 = 0) u) x WHERE rn = 1")
sql_query("event_rollup", "SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY user_id, event_type")
