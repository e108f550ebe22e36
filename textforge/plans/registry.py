"""All queries of the library and their SQL: ``query`` registers a function over the tables of a folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes; ``corpus`` is documents under the names of a song corpus."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def corpus(self) -> DataFrame:
        d = self.documents
        title = F.substring(F.split(F.coalesce("text", F.lit("")), "\n", 2)[0], 1, 40)
        return d.select(F.col("doc_id").alias("song_id"), title.alias("title"), F.col("source").alias("artist"), F.col("lang").alias("category"), F.col("text").alias("lyrics"))


#: The same view in SQL.
CORPUS = "corpus AS (SELECT doc_id AS song_id, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 40) AS title, source AS artist, lang AS category, text AS lyrics FROM documents)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_query(name: str, text: str, **dialect: tuple[str, str]) -> None:
    """A query in SQL that both engines read: {table} stands for a table, other names for (Spark's, DuckDB's) wording."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {n: getattr(Tables(spark, sf_dir), n) for n in TABLES if "{" + n + "}" in text}
        ours = text
        for key, (mine, _) in dialect.items():
            ours = ours.replace("{" + key + "}", mine)
        for n, df in used.items():
            df.createOrReplaceTempView(f"textforge_{n}")
            ours = ours.replace("{" + n + "}", f"textforge_{n}")
        return spark.sql(ours)

    QUERIES[name] = run
    theirs = text
    for key, (_, other) in dialect.items():
        theirs = theirs.replace("{" + key + "}", other)
    for n in TABLES:
        theirs = theirs.replace("{" + n + "}", n)
    ORACLE[name] = theirs


for _name in ("retrieval", "dedup", "vectors", "quality", "joins", "events", "queues", "pages", "lexicon", "mood", "ops", "exchange", "cleaning", "matching", "state", "services"):
    importlib.import_module(f"textforge.plans.{_name}")
