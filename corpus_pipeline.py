"""A training-data pipeline over ``documents``: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from textforge.llm.store import drop, keep, release, table
from textforge.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted to the labelled ones, scores below one half."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.add_score(docs, model, docs.columns).where("score < 0.5").drop("score")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated passages but in their first place."""
    ship(spark)
    return line_dedup.dedup_lines(docs).drop("removed_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the lowest doc_id, of each group of near duplicates."""
    ship(spark)
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids (binary, little-endian unsigned 32-bit), their number and the decoded bytes' digest."""
    ship(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL has no model fits, hash functions or merges of this kind; tests hold what each stage computes against brute force or exact
#: counts (label model and scores, repeated windows, all pairs of texts, sums of the mix, the tokenizer's library).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            drop(spark, last)
        release(spark)
        last = path  # the result reads the last one
    return STAGES[-1][1](spark, docs, sf_dir)
