"""BM25 retrieval over postings, phrase bonus, TF-IDF keywords, score fusion, re-ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as tx

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): map-side counts of exploded tokens."""
    return docs.select(key, F.explode(tx.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, text: str) -> DataFrame:
    """One row: documents, and their mean number of tokens, which are counted without being cut out."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(tx.TOKEN))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def term_stats(post: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf); totals has one row with n."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(totals)).withColumn("idf", idf(F.col("n"), F.col("df")))


def query_terms(queries: DataFrame, key: str, text: str, words: int = 8) -> DataFrame:
    """(key, term, qf) of the first ``words`` tokens; a repeated token counts as often as it stands there."""
    first = F.slice(tx.tokens(F.col(text)), 1, words)
    return queries.select(key, F.explode(first).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("qf"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, doc_text: str, qid: str, query_text: str, words: int = 8) -> DataFrame:
    """(qid, doc, score) of all documents that share a term with a query.

    Only postings of query terms are joined: documents' token lists are filtered by the queries' distinct terms, which Spark
    broadcasts only if they are small.
    """
    terms = query_terms(queries, qid, query_text, words)
    tokens = docs.select(doc, tx.tokens(F.col(doc_text)).alias("w")).select(doc, F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    # Each token carries its document's length, so that texts are cut into tokens once and lengths need no join.
    post = tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy(doc, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    stats = term_stats(post, lengths(docs, doc_text))
    hits = post.join(stats, "term").join(terms, "term")
    gain = F.col("idf") * F.col("qf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(qid, doc).agg(F.sum(gain).alias("score"))


def top_k(scores: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The k best of each query, ties by item; Spark prunes to k in each task before it shuffles."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def min_max(score: Column, low: Column, high: Column) -> Column:
    """0 to 1 between the lowest and the highest; all 0 where all are equal."""
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(0.0))


def fuse(scores: DataFrame, query: str, dense: str, lexical: str, weight: float = 0.65) -> DataFrame:
    """Adds fused = (1 - weight) * dense + weight * lexical of min-max scores; missing and not finite ones count as 0.

    Ends are aggregated and joined, so that no task holds all items of a query.
    """
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie between 0 and 1")

    def clean(c: str) -> Column:
        x = F.col(c)
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)

    rows = scores.withColumn("d", clean(dense)).withColumn("l", clean(lexical))
    ends = rows.groupBy(query).agg(*[f(c).alias(f"{n}_{c}") for c in "dl" for f, n in ((F.min, "low"), (F.max, "high"))])
    part = lambda c: min_max(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}"))
    out = rows.join(ends, query).withColumn("fused", (1 - weight) * part("d") + weight * part("l"))
    return out.select(*scores.columns, "fused")


def tfidf(docs: DataFrame, key: str, text: str, stop: list[str], most: float = 0.6, least: int = 2) -> DataFrame:
    """(key, term, weight): smooth idf, L2-normalised; terms of one character, digits, stop words and too rare or common ones go."""
    post = postings(docs, key, text).where((F.length("term") > 1) & ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(stop))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= most * F.col("n")))
    rows = post.join(df, "term").withColumn("w", F.col("tf") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return rows.select(key, "term", (F.col("w") / norm).alias("weight"))


def mmr(candidates: DataFrame, query: str, item: str, relevance: str, vector: str, k: int = 10, trade: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance in each query's candidates (a bounded list, so one task holds it whole).

    Relevance is min-max scaled (all equal: 1); redundancy is the largest cosine to the items chosen so far; ties go to the first
    by relevance, then item.
    """
    kinds = candidates.schema

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values([relevance, item], ascending=[False, True]).reset_index(drop=True)
        rel = pdf[relevance].to_numpy(float)
        rel = (rel - rel.min()) / (rel.max() - rel.min()) if rel.max() > rel.min() else np.ones(len(rel))
        v = np.array(pdf[vector].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        left, chosen, out = list(range(len(pdf))), [], []
        while left and len(chosen) < k:
            score = [trade * rel[i] - (1 - trade) * (max(v[i] @ v[j] for j in chosen) if chosen else 0.0) for i in left]
            best = left[int(np.argmax(score))]
            out.append(max(score))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({query: pdf[query].iloc[0], item: pdf[item].iloc[chosen].to_numpy(), "rank": range(1, len(chosen) + 1), "mmr": out})

    shape = f"{query} {kinds[query].dataType.simpleString()}, {item} {kinds[item].dataType.simpleString()}, rank long, mmr double"
    return candidates.select(query, item, relevance, vector).groupBy(query).applyInPandas(rerank, shape)
