"""Queries of exact de-duplication, survivorship and near-duplicate review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as tx
from textforge.operators import survivors as s

from .registry import CORPUS, Tables, query, sql_query

SHA = "sha256(lower(trim(regexp_replace(nfc_normalize(coalesce(lyrics, '')), '\\s+', ' ', 'g'))))"
FOLD = "trim(regexp_replace(replace(lower(nfc_normalize(coalesce({c}, ''))), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\x{{0900}}-\\x{{097F}}]+', ' ', 'g'))"


@query(f"WITH {CORPUS}, h AS (SELECT song_id, {SHA} AS sha FROM corpus) SELECT sha, count(*) AS n, min(song_id) AS first_id FROM h GROUP BY sha HAVING count(*) > 1")
def exact_dup_groups(t: Tables) -> DataFrame:
    rows = t.corpus.select("song_id", tx.content_hash(F.col("lyrics")).alias("sha"))
    return rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("song_id").alias("first_id")).where("n > 1")


@query(f"WITH {CORPUS}, k AS (SELECT *, row_number() OVER (PARTITION BY {SHA} ORDER BY song_id) AS rn FROM corpus) SELECT song_id, artist, category FROM k WHERE rn = 1")
def first_per_key(t: Tables) -> DataFrame:
    return s.first_of(t.corpus.withColumn("sha", tx.content_hash(F.col("lyrics"))), ["sha"], ["song_id"]).select("song_id", "artist", "category")


AUDIT = f"""WITH {CORPUS}, a AS (SELECT *, len(regexp_extract_all(lower(coalesce(lyrics, '')), '[\\x{{0900}}-\\x{{097F}}]+|[A-Za-z0-9]+')) AS n FROM corpus),
b AS (SELECT *, trim(coalesce(lyrics, '')) = '' AS blank FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY lyrics ORDER BY song_id) AS r1 FROM b WHERE NOT blank),
d AS (SELECT *, row_number() OVER (PARTITION BY title, artist ORDER BY song_id) AS r2 FROM c WHERE r1 = 1), e AS (SELECT * FROM d WHERE r2 = 1)
SELECT (SELECT count(*) FROM b) AS rows_in, (SELECT count_if(blank) FROM b)::BIGINT AS blank, (SELECT count_if(r1 > 1) FROM c)::BIGINT AS same_lyrics, (SELECT count_if(r2 > 1) FROM d)::BIGINT AS same_title,
  (SELECT count_if(n < 10) FROM e)::BIGINT AS too_short, (SELECT count(*) FROM e WHERE n >= 10) AS rows_out, (SELECT min(n) FROM e WHERE n >= 10)::BIGINT AS least, (SELECT quantile_cont(n, 0.5) FROM e WHERE n >= 10)::DOUBLE AS middle, (SELECT max(n) FROM e WHERE n >= 10)::BIGINT AS most"""


@query(AUDIT)
def audit_chain(t: Tables) -> DataFrame:
    return s.audit(t.corpus)


@query(f"""WITH {CORPUS}, k AS (SELECT song_id, artist, title, row_number() OVER (PARTITION BY {FOLD.format(c="artist")}, {FOLD.format(c="title")}
  ORDER BY CASE artist WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 ELSE 6 END, CASE category WHEN 'en' THEN 0 ELSE 1 END, song_id) AS rank FROM corpus) SELECT song_id, rank FROM k""")
def survivorship_rank(t: Tables) -> DataFrame:
    c = t.corpus.withColumn("key", F.concat_ws("|", tx.fold(F.col("artist")), tx.fold(F.col("title"))))
    order = [s.priority(F.col("artist"), {"src0": 1, "src1": 2, "src2": 3}, 6), F.when(F.col("category") == "en", 0).otherwise(1), F.col("song_id")]
    return s.ranked(c, ["key"], order).select("song_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, CASE WHEN event_type IN ('error', 'click') THEN NULL ELSE event_type END AS filled FROM events)
SELECT user_id, min(CASE WHEN rank = 1 THEN event_id END) AS winner, arg_min(filled, rank) FILTER (filled IS NOT NULL) AS kind, min(rank) FILTER (filled IS NOT NULL) AS from_rank FROM e GROUP BY user_id""")
def sibling_fill(t: Tables) -> DataFrame:
    e = t.events.withColumn("filled", F.when(~F.col("event_type").isin("error", "click"), F.col("event_type")))
    return s.fill_from_siblings(e, "user_id", ["ts", "event_id"], "event_id", "filled").select("user_id", "winner", F.col("filled").alias("kind"), "from_rank")


sql_query("dup_mark", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, CASE WHEN o_totalprice > 0 THEN 0 ELSE 1 END, o_orderkey) > 1 AS duplicate FROM {orders}")


@query(f"WITH {CORPUS} SELECT song_id, {FOLD.format(c='artist')} || '|' || {FOLD.format(c='title')} || '|' || CASE WHEN song_id % 7 > 0 THEN CAST(floor((song_id % 7 * 60) / 5) AS BIGINT)::VARCHAR ELSE '' END AS key FROM corpus")
def dedupe_key(t: Tables) -> DataFrame:
    return t.corpus.select("song_id", tx.dedupe_key(F.col("artist"), F.col("title"), F.col("song_id") % 7 * 60).alias("key"))


@query(f"""WITH {CORPUS}, g AS (SELECT song_id, artist, category, CASE WHEN n = '' THEN 'id:' || song_id ELSE n END AS grp, length(lyrics) AS size FROM (SELECT *, array_to_string(regexp_extract_all(lower(coalesce(lyrics, '')), '[\\x{{0900}}-\\x{{097F}}]+|[A-Za-z0-9]+'), ' ') AS n FROM corpus)),
b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size DESC, song_id) AS base FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY category, grp ORDER BY base) AS rn FROM b)
SELECT category, song_id, row_number() OVER (PARTITION BY category ORDER BY base) AS rank FROM k WHERE rn = 1""")
def collapse_ranked(t: Tables) -> DataFrame:
    norm = F.array_join(tx.tokens(F.col("lyrics")), " ")
    c = t.corpus.withColumn("grp", F.when(norm == "", F.concat(F.lit("id:"), F.col("song_id"))).otherwise(norm))
    c = c.withColumn("base", F.row_number().over(Window.partitionBy("category").orderBy(F.desc(F.length("lyrics")), "song_id")))
    kept = s.first_of(c, ["category", "grp"], ["base"])
    return kept.select("category", "song_id", F.row_number().over(Window.partitionBy("category").orderBy("base")).cast("long").alias("rank"))


NAMES = """w AS (SELECT min(p_partkey) AS id, count(*) AS members, lower(p_name) AS name FROM part GROUP BY lower(p_name)), g AS (SELECT DISTINCT id, substr(name, i::BIGINT, 4) AS gram FROM (SELECT id, name, unnest(range(1, greatest(length(name) - 2, 2))) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id), j AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL),
s AS (SELECT left_id, right_id, shared / (x.n + y.n - shared)::DOUBLE AS jaccard FROM j JOIN n x ON x.id = left_id JOIN n y ON y.id = right_id)"""


@query(f"WITH {NAMES} SELECT left_id, right_id, round(jaccard, 6) AS jaccard, x.members AS left_n, y.members AS right_n FROM s JOIN w x ON x.id = left_id JOIN w y ON y.id = right_id WHERE jaccard >= 0.6")
def shingle_jaccard_pairs(t: Tables) -> DataFrame:
    return s.jaccard_pairs(t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name")), "id", "name", 4, 0.6).select("left_id", "right_id", F.round("jaccard", 6).alias("jaccard"), "left_n", "right_n")


@query(f"""WITH {NAMES} SELECT left_id, right_id, CASE WHEN x.p_brand = y.p_brand THEN 'merge_candidate' WHEN jaccard >= 0.9 THEN 'review_title_variant' ELSE 'review' END AS action,
  CASE WHEN y.p_size < x.p_size THEN right_id ELSE left_id END AS keep FROM s JOIN part x ON x.p_partkey = left_id JOIN part y ON y.p_partkey = right_id WHERE jaccard >= 0.6""")
def review_actions(t: Tables) -> DataFrame:
    pairs = s.jaccard_pairs(t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name")), "id", "name", 4, 0.6)
    side = lambda n: t.part.select(F.col("p_partkey").alias(f"{n}_id"), F.col("p_brand").alias(f"{n}_brand"), F.col("p_size").alias(f"{n}_size"))
    rows = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    action = F.when(F.col("left_brand") == F.col("right_brand"), "merge_candidate").when(F.col("jaccard") >= 0.9, "review_title_variant").otherwise("review")
    return rows.select("left_id", "right_id", action.alias("action"), F.when(F.col("right_size") < F.col("left_size"), F.col("right_id")).otherwise(F.col("left_id")).alias("keep"))
