"""Queries of full-text retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as tx
from textforge.operators import retrieval as r

from .registry import Tables, query

TOK = r"regexp_extract_all(lower(coalesce({c}, '')), '[\x{{0900}}-\x{{097F}}]+|[A-Za-z0-9]+')"
DTOK, BTOK = TOK.format(c="text"), TOK.format(c="text")
STOP = "the of and to in that is was for on with as are at by this it be or from les des que qui une est dans pour der die das und von den mit de la el los en y".split()

BM25 = f"""
dt AS (SELECT doc_id, unnest({DTOK}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dl AS (SELECT doc_id, len({DTOK}) AS dl FROM documents),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({BTOK}[1:8]) AS term FROM benchmark) GROUP BY ALL),
st AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT qt.item_id, post.doc_id,
    sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * qf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM qt JOIN post USING (term) JOIN st USING (term) JOIN dl USING (doc_id) CROSS JOIN tot GROUP BY ALL)"""


@query(f"SELECT doc_id, CAST(len({DTOK}) AS BIGINT) AS n_tokens FROM documents")
def tokenize_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"""WITH dt AS (SELECT DISTINCT doc_id, unnest({DTOK}) AS term FROM documents), s AS (SELECT term, count(*) AS df FROM dt GROUP BY term)
SELECT term, df, round(ln(((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM s""")
def doc_stats(t: Tables) -> DataFrame:
    post = r.postings(t.documents, "doc_id", "text")
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    return r.term_stats(post, n).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {BM25}, k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10""")
def bm25_topk(t: Tables) -> DataFrame:
    scores = r.bm25(t.documents, t.benchmark, "doc_id", "text", "item_id", "text").withColumn("score", F.round("score", 6))
    return r.top_k(scores, "item_id", "doc_id", "score", 10).select("item_id", "doc_id", "score", "rank")


@query(f"""WITH {BM25},
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc),
ph AS (SELECT item_id, ' ' || array_to_string({BTOK}[1:8], ' ') || ' ' AS phrase FROM benchmark),
bonus AS (SELECT item_id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) AS bonus, count(*) AS terms FROM qt JOIN st USING (term) CROSS JOIN tot GROUP BY item_id),
dj AS (SELECT doc_id, ' ' || array_to_string({DTOK}, ' ') || ' ' AS joined FROM documents)
SELECT k.item_id, k.doc_id, round(bonus, 6) AS bonus FROM k JOIN ph USING (item_id) JOIN bonus USING (item_id) JOIN dj USING (doc_id)
WHERE k.rank <= 2000 AND terms > 1 AND contains(joined, phrase)""")
def bm25_phrase_bonus(t: Tables) -> DataFrame:
    scores = r.bm25(t.documents, t.benchmark, "doc_id", "text", "item_id", "text").withColumn("score", F.round("score", 6))
    top = r.top_k(scores, "item_id", "doc_id", "score", 2000).select("item_id", "doc_id")
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    terms = r.query_terms(t.benchmark, "item_id", "text")
    stats = r.term_stats(r.postings(t.documents, "doc_id", "text").join(terms.select("term").distinct(), "term", "left_semi"), n)
    known = terms.join(stats, "term").groupBy("item_id").agg(F.sum("idf").alias("bonus"), F.count(F.lit(1)).alias("terms")).where("terms > 1")
    pad = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    phrases = t.benchmark.select("item_id", pad(F.slice(tx.tokens(F.col("text")), 1, 8)).alias("phrase"))
    joined = t.documents.select("doc_id", pad(tx.tokens(F.col("text"))).alias("joined"))
    rows = top.join(known, "item_id").join(phrases, "item_id").join(joined, "doc_id").where(F.contains("joined", "phrase"))
    return rows.select("item_id", "doc_id", F.round("bonus", 6).alias("bonus"))


@query(f"""WITH dt AS (SELECT doc_id, unnest({DTOK}) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE length(term) > 1 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ({", ".join(f"'{s}'" for s in STOP)}) GROUP BY ALL),
tot AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT doc_id, term, tf * (ln((n + 1) / (df + 1)::DOUBLE) + 1) AS w FROM post JOIN df USING (term) CROSS JOIN tot WHERE df >= 2 AND df <= 0.6::DOUBLE * n),
x AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM x)
SELECT doc_id, term, weight, rank FROM k WHERE rank <= 5""")
def tfidf_keywords(t: Tables) -> DataFrame:
    rows = r.tfidf(t.documents, "doc_id", "text", STOP).withColumn("weight", F.round("weight", 6))
    return r.top_k(rows, "doc_id", "term", "weight", 5).select("doc_id", "term", "weight", "rank")


@query(f"""WITH dt AS (SELECT DISTINCT doc_id, unnest({DTOK}) AS term FROM documents), st AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
tot AS (SELECT count(*) AS n FROM documents), q AS (SELECT item_id, unnest(CASE item_id % 4 WHEN 0 THEN {BTOK}[1:1] WHEN 1 THEN {BTOK}[1:2] ELSE {BTOK} END) AS term FROM benchmark),
a AS (SELECT item_id, count(df) AS known, min(CASE WHEN df IS NOT NULL THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) END) AS low,
  coalesce(bool_or(regexp_matches(term, '[\\x{{0900}}-\\x{{097F}}]')), false) AS devanagari FROM q LEFT JOIN st USING (term) CROSS JOIN tot GROUP BY item_id)
SELECT item_id, known, CASE WHEN known < 2 THEN false WHEN known >= 3 THEN true ELSE devanagari AND low >= 2.5 END AS fuse FROM a""")
def should_fuse_gate(t: Tables) -> DataFrame:
    stats = r.term_stats(r.postings(t.documents, "doc_id", "text"), t.documents.agg(F.count(F.lit(1)).alias("n"))).select("term", "df", "idf")
    tokens, short = tx.tokens(F.col("text")), F.col("item_id") % 4  # passages of one and two words, and whole ones
    words = t.benchmark.select("item_id", F.explode(F.when(short == 0, F.slice(tokens, 1, 1)).when(short == 1, F.slice(tokens, 1, 2)).otherwise(tokens)).alias("term"))
    rows = words.join(stats, "term", "left").groupBy("item_id").agg(F.count("df").alias("known"), F.min("idf").alias("low"), F.bool_or(F.col("term").rlike("[\\x{0900}-\\x{097F}]")).alias("devanagari"))
    fuse = F.when(F.col("known") < 2, False).when(F.col("known") >= 3, True).otherwise(F.col("devanagari") & (F.col("low") >= 2.5))
    return rows.select("item_id", "known", fuse.alias("fuse"))


DENSE = """
dv AS (SELECT b.item_id, e.vec_id AS doc_id, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dense
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e)"""


@query(f"""WITH {BM25}, {DENSE},
j AS (SELECT item_id, doc_id, coalesce(dense, 0) AS d, coalesce(score, 0) AS l FROM dv FULL JOIN sc USING (item_id, doc_id)),
f AS (SELECT item_id, doc_id, round(0.35::DOUBLE * CASE WHEN max(d) OVER w > min(d) OVER w THEN (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) ELSE 0 END
  + 0.65::DOUBLE * CASE WHEN max(l) OVER w > min(l) OVER w THEN (l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w) ELSE 0 END, 6) AS fused FROM j WINDOW w AS (PARTITION BY item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM f)
SELECT item_id, doc_id, fused, rank FROM k WHERE rank <= 10""")
def hybrid_topk(t: Tables) -> DataFrame:
    from textforge.operators import vectors as v

    e = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    queries = t.benchmark.select("item_id").join(e.select(F.col("vec_id").alias("item_id"), F.col("v").alias("q")), "item_id")
    dense = v.score_all(queries, e.select(F.col("vec_id").alias("doc_id"), "v"), "item_id", "doc_id").withColumnRenamed("score", "dense")
    lexical = r.bm25(t.documents, t.benchmark, "doc_id", "text", "item_id", "text").withColumnRenamed("score", "lexical")
    fused = r.fuse(dense.join(lexical, ["item_id", "doc_id"], "full"), "item_id", "dense", "lexical").withColumn("fused", F.round("fused", 6))
    return r.top_k(fused, "item_id", "doc_id", "fused", 10).select("item_id", "doc_id", "fused", "rank")


@query()
def mmr_rerank(t: Tables) -> DataFrame:
    from textforge.operators import vectors as v

    e = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    queries = t.benchmark.select("item_id").join(e.select(F.col("vec_id").alias("item_id"), F.col("v").alias("q")), "item_id")
    top = r.top_k(v.score_all(queries, e.select(F.col("vec_id").alias("doc_id"), "v"), "item_id", "doc_id"), "item_id", "doc_id", "score", 50)
    return r.mmr(top.join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id"), "item_id", "doc_id", "score", "v")


PASSAGES = "rel AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def relevant(t: Tables) -> DataFrame:
    """(item_id, doc_id) of documents that hold a passage: found by its rarest inner word, then verified.

    A passage's first and last word may be parts of longer ones in a document; passages of no inner word, which are few and
    short, are looked for in every document.
    """
    cut = lambda c: F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    words = t.benchmark.select("item_id", F.col("text").alias("passage"), cut(F.col("text")).alias("w"))
    inner = words.where("size(w) > 2").select("item_id", "passage", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.size("w") - 2))).alias("word"))
    docs = t.documents.select("doc_id", F.explode(F.array_distinct(cut(F.col("text")))).alias("word"))
    df = docs.join(inner.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rare = inner.join(df, "word", "left").withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "word"))).where("n = 1")
    found = docs.join(rare.select("item_id", "passage", "word"), "word").join(t.documents.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage"))
    short = words.where("size(w) <= 2").join(t.documents.select("doc_id", "text"), F.contains("text", "passage"))
    return found.select("item_id", "doc_id").union(short.select("item_id", "doc_id")).distinct()


@query(f"""WITH {BM25}, {PASSAGES},
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc),
m AS (SELECT k.item_id, k.rank, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM k LEFT JOIN rel USING (item_id, doc_id) WHERE k.rank <= 10),
i AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rel DESC, rank) AS best FROM m),
n AS (SELECT item_id, count(*) AS total FROM rel GROUP BY item_id)
SELECT i.item_id, round(coalesce(sum(rel / log2(rank + 1)) / nullif(sum(rel / log2(best + 1)), 0), 0), 6) AS ndcg,
  round(coalesce(sum(rel) / nullif(max(total), 0)::DOUBLE, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS mrr
FROM i LEFT JOIN n USING (item_id) GROUP BY i.item_id""")
def ndcg_recall_mrr(t: Tables) -> DataFrame:
    from textforge.operators import metrics

    scores = r.bm25(t.documents, t.benchmark, "doc_id", "text", "item_id", "text").withColumn("score", F.round("score", 6))
    return metrics.ranking(r.top_k(scores, "item_id", "doc_id", "score", 10).select("item_id", "doc_id", "rank"), relevant(t), "item_id", "doc_id")


@query(f"""WITH {BM25}, {PASSAGES},
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc),
m AS (SELECT k.item_id, CASE WHEN rel.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM k LEFT JOIN rel USING (item_id, doc_id) WHERE k.rank <= 10),
n AS (SELECT item_id, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS p FROM rel GROUP BY item_id)
SELECT m.item_id, round(avg(rel), 6) AS precision_at_10, CAST(max(rel) AS BIGINT) AS hit_at_10, round(1 - pow(1 - coalesce(max(p), 0), 10), 6) AS base_rate
FROM m LEFT JOIN n USING (item_id) GROUP BY m.item_id""")
def precision_hit_base(t: Tables) -> DataFrame:
    scores = r.bm25(t.documents, t.benchmark, "doc_id", "text", "item_id", "text").withColumn("score", F.round("score", 6))
    top, rel = r.top_k(scores, "item_id", "doc_id", "score", 10), relevant(t).withColumn("rel", F.lit(1))
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    share = rel.groupBy("item_id").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).select("item_id", (F.col("k") / F.col("n")).alias("p"))
    rows = top.join(rel, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.avg(F.coalesce("rel", F.lit(0))).alias("a"), F.max(F.coalesce("rel", F.lit(0))).alias("h")).join(share, "item_id", "left")
    return rows.select("item_id", F.round("a", 6).alias("precision_at_10"), F.col("h").cast("long").alias("hit_at_10"), F.round(1 - F.pow(1 - F.coalesce("p", F.lit(0.0)), 10), 6).alias("base_rate"))
