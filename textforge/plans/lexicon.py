"""Queries of readings, bigrams and fuzzy matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as tx
from textforge.operators import fuzzy

from .registry import Tables, query, sql_query

READ = "(SELECT lower(substr(p_name, 1, 4)) AS form, split_part(p_name, ' ', 2) AS reading, count(*) AS n FROM {part} GROUP BY 1, 2) r"
sql_query("majority_reading", f"SELECT form, reading, round(n / CAST(total AS DOUBLE), 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY form) AS total, row_number() OVER (PARTITION BY form ORDER BY n DESC, reading) AS rn FROM {READ}) x WHERE rn = 1")
sql_query("denoise_pairs", f"SELECT form, reading, n FROM (SELECT *, sum(n) OVER (PARTITION BY form) AS total, row_number() OVER (PARTITION BY form ORDER BY n DESC, reading) AS rn FROM {READ}) x WHERE rn = 1 OR total < 2")
sql_query("ambiguous_readings", f"SELECT form, count(*) AS readings FROM {READ} WHERE n >= 2 GROUP BY form HAVING count(*) >= 2")
sql_query("longest_reading", "SELECT form, max(size) AS size FROM (SELECT lower(substr(p_name, 1, 4)) AS form, length(p_name) * CAST(1 AS BIGINT) AS size FROM {part}) x GROUP BY form")
sql_query("unambiguous_gold", f"SELECT form, min(reading) AS reading FROM {READ} GROUP BY form HAVING count(DISTINCT reading) = 1")

TURNS = "regexp_extract_all(lower(coalesce(text, '')), '[\\x{0900}-\\x{097F}]+|[A-Za-z0-9]+')"


@query(f"""WITH t AS (SELECT conv_id, turn, list_concat(['<s>'], {TURNS}, ['</s>']) AS w FROM conversations), b AS (SELECT w[i::BIGINT] AS a, w[i::BIGINT + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t)),
c AS (SELECT a, b, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rank FROM c) SELECT a, b, n, rank FROM k WHERE rank <= 12""")
def bigram_top12(t: Tables) -> DataFrame:
    w = F.concat(F.array(F.lit("<s>")), tx.tokens(F.col("text")), F.array(F.lit("</s>")))
    pairs = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))
    rows = t.conversations.select(w.alias("w")).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b")).cast("long")).where("rank <= 12")


@query(f"""WITH d AS (SELECT unnest(regexp_extract_all(lower(text), '[\\x{{0900}}-\\x{{097F}}]+|[A-Za-z0-9]+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM d GROUP BY w),
x AS (SELECT DISTINCT unnest({TURNS}) AS w FROM conversations) SELECT CAST(sum(n) AS BIGINT) AS words, CAST(sum(CASE WHEN x.w IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS known, round(sum(CASE WHEN x.w IS NOT NULL THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS ratio FROM c LEFT JOIN x USING (w)""")
def coverage_ratio(t: Tables) -> DataFrame:
    counts = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    lexicon = t.conversations.select(F.explode(tx.tokens(F.col("text"))).alias("w")).distinct().withColumn("known", F.lit(1))
    rows = counts.join(lexicon, "w", "left")
    known = F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0))
    return rows.agg(F.sum("n").alias("words"), known.alias("known"), F.round(known / F.sum("n"), 6).alias("ratio"))


@query()
def fuzzy_expand(t: Tables) -> DataFrame:
    """Expansions of query tokens that are unknown or in at most ten documents, by terms as rare."""
    df = t.documents.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    queries = t.benchmark.select(F.explode(F.slice(tx.tokens(F.col("text")), 1, 8)).alias("token")).where("length(token) >= 3").distinct()
    queries = queries.join(df.withColumnRenamed("term", "token"), "token", "left").select("token", F.coalesce("df", F.lit(0)).alias("df")).where("df <= 10")
    return fuzzy.expand(queries, df.where("length(term) >= 3"))


@query()
def token_set_match(t: Tables) -> DataFrame:
    left = t.part.select(F.col("p_partkey").alias("left_id"), F.lower("p_name").alias("left_name"))
    right = t.part.select(F.col("p_partkey").alias("right_id"), F.lower("p_name").alias("right_name"))
    return fuzzy.best_match(left, right)


@query()
def lyric_similarity(t: Tables) -> DataFrame:
    a = t.conversations.where("turn = 0").select("conv_id", F.col("text").alias("x"))
    b = t.conversations.where("turn = 1").select("conv_id", F.col("text").alias("y"))
    return a.join(b, "conv_id").select("conv_id", fuzzy.text_similarity("x", "y").alias("similarity"))
