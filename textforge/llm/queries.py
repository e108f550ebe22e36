"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_crf, line_dedup, mixing, order_minhash, png, secret_scan, simhash, token_files, toxicity
from .store import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, lengths, _ = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(files, lengths, with_ids=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "removed_chars")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.add_secrets(table(spark, sf_dir, "documents"), ["doc_id"], secret_scan.trained()).drop("n_model")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.add_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"], html_crf.trained())


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.add_score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edits(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
    return rows.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), "decoded_sha256")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = png.add_media(table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("media_hash")).alias("feature"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_line_dedup, op3_mix_sources, op4_secret_scan, op5_main_text, op6_simhash_groups, op7_toxicity, op8_order_minhash, op9_bpe, op10_media)}

WORDS = r"[^\x20\x09-\x0D]+"
ORACLE = {
    "op3_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size,
    0.5 + CASE WHEN length(coalesce(text, '')) > 0
      THEN CAST(length(regexp_replace(text, '[^\p{{L}}\s]+', '', 'g')) AS DOUBLE) / length(text) ELSE 0.0 END AS quality,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / CAST(quality AS DOUBLE) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
    ([3.0, 1.0, 2.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight FROM k GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS total FROM s),
o AS (SELECT *, cap / weight AS tip,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_words,
    sum(weight) OVER (ORDER BY cap / weight, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM c),
l AS (SELECT *, (total - full_words) / open_weight AS level FROM o),
m AS (SELECT arg_min(level, tip) AS level FROM l WHERE level <= tip),
t AS (SELECT l.source, l.source_size, round(CASE WHEN m.level IS NULL THEN cap ELSE least(cap, m.level * weight) END, 6) AS target FROM l, m),
r AS (SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND target - epochs * source_size > 0 AND reached - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""",
}
