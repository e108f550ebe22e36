"""Health of datasets: contracts, freshness, changes of size, manifests, rebuilding with a quarantine, and reports for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import Contract, Field, checks, validate

FLAG = Field("int", allowed=(0, 1))
SHARE = Field("float", nullable=False, least=0.0, most=1.0)
SCORE = Field("float", nullable=False, least=0.0, most=100.0)
ID, ANY, NAME = Field("str", pattern="\\d+"), Field("str"), Field("str", nullable=False)
NEW_ID = "A-[0-9a-f]{10}"
MATCHES = ("strong", "probable", "weak", "none")
BASES = ("metadata_only", "metadata_candidate", "no_lyrics", "new_lyrics_too_short", "lyrics_confirmed", "lyrics_ambiguous_linked", "new_lyrics_non_nepali", "new_lyrics")
TRACK = {"track_key": NAME, "artist": ANY, "title": NAME, "duration_s": Field("float", nullable=False, least=0.0), "n_files": Field("int", nullable=False, least=1), "files": ANY, "source_query": ANY, "cand_song_id": ID, "cand_title": ANY, "cand_artist": ANY, "title_score": SCORE, "artist_score": SCORE, "metadata_match": Field("str", nullable=False, allowed=MATCHES)}
#: What the nine datasets have to be.
CONTRACTS = {
    c.name: c
    for c in (
        Contract("cleaned_lyrics", {"song_id": Field("int", nullable=False, least=0), "title": ANY, "artist": ANY, "category": ANY, "lyrics": NAME, "token_count": Field("int", nullable=False, least=1)}, key=("song_id",)),
        Contract("corpus_rows", {"category": ANY, "title_clean": ANY, "artist_clean": ANY, "lyrics_devanagari": ANY, "line_count": Field("int", nullable=False, least=0), "char_count": Field("int", nullable=False, least=0), "script_style_original": ANY, "script_style_cleaned": ANY, "transliterated": Field("int", nullable=False, allowed=(0, 1)), "source": ANY, "stage": ANY, "source_url": ANY}),
        Contract("mood_labels", {"song_id": Field("int", nullable=False, least=0), **{c: FLAG for c in ("positive", "negative", "joy", "sadness", "anger", "fear", "depression")}, "mood_phrase": ANY, "confidence": ANY}, key=("song_id",)),
        Contract("sentiment_scores", {"song_id": Field("int", nullable=False, least=0), **{c: SHARE for c in ("joy", "sadness", "anger", "fear", "depression", "positive", "negative")}, "sentiment_score": Field("float", nullable=False, least=-1.0, most=1.0), "sentiment_label": Field("str", allowed=("positive", "negative", "neutral"))}, key=("song_id",)),
        Contract("audio_tracks", TRACK, key=("track_key",)),
        Contract("audio_manifest", {"audio_name": NAME, "audio_relpath": NAME, "ext": NAME, "bytes": Field("int", nullable=False, least=0), "track_key": NAME, "artist": ANY, "title": NAME, "duration_s": Field("float", least=0.0), "source_query": ANY, "metadata_from": ANY, "cand_song_id": ID, "cand_title": ANY, "cand_artist": ANY, "title_score": Field("float", least=0.0, most=100.0), "artist_score": Field("float", least=0.0, most=100.0), "metadata_match": Field("str", allowed=MATCHES)}, key=("audio_name",)),
        Contract("audio_track_matches", {**TRACK, "match_song_id": ID, "new_id": Field("str", pattern=NEW_ID), "match_basis": Field("str", allowed=BASES), "lyrics_sim": Field("float", least=0.0, most=100.0), "nepali_ratio": Field("float", least=0.0, most=1.0), "final_song_id": ID}, key=("track_key",)),
        Contract("audio_file_map", {"audio_name": NAME, "audio_relpath": NAME, "track_key": NAME, "artist": ANY, "title": NAME, "metadata_match": Field("str", allowed=MATCHES), "cand_song_id": ID, "match_song_id": ID, "new_id": Field("str", pattern=NEW_ID), "match_basis": Field("str", allowed=BASES), "final_song_id": ID}, key=("audio_name",)),
        Contract("audio_new_songs", {"audio_song_id": Field("str", nullable=False, pattern=NEW_ID), "track_key": NAME, "audio_artist": ANY, "audio_title": NAME, "duration_s": Field("float", nullable=False, least=0.0), "n_files": Field("int", nullable=False, least=1), "lyrics_source": ANY, "source_url": ANY, "category": ANY, "title_clean": ANY, "artist_clean": ANY, "lyrics_devanagari": NAME, "line_count": Field("int", nullable=False, least=1), "char_count": Field("int", nullable=False, least=1), "script_style_original": ANY, "script_style_cleaned": ANY, "transliterated": Field("int", nullable=False, allowed=(0, 1)), "token_count": Field("int", nullable=False, least=1)}, key=("audio_song_id",)),
    )
}


def validate_all(tables: dict[str, DataFrame | None], strict: bool = False) -> DataFrame:
    """(dataset, check, failures, examples) of all datasets that are there; absent ones are skipped, or fail if ``strict``."""
    parts = []
    spark: SparkSession = next(t for t in tables.values() if t is not None).sparkSession
    for name, rows in tables.items():
        if rows is None:
            found = spark.createDataFrame([("dataset:missing", int(strict), [])], "check string, failures long, examples array<string>")
        else:
            found = validate(rows, CONTRACTS[name])
        parts.append(found.select(F.lit(name).alias("dataset"), "check", "failures", "examples"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health(facts: DataFrame, last: DataFrame, now: Column, stale_hours: float, most_change: float) -> DataFrame:
    """(dataset, rows, delta, age_hours, status) of facts (dataset, rows, modified, failures) against the last report's rows."""
    rows = facts.join(last.select("dataset", F.col("rows").alias("was")), "dataset", "left")
    age = (F.unix_timestamp(now) - F.unix_timestamp("modified")) / 3600
    delta = F.col("rows") - F.col("was")
    status = F.when(F.col("failures") > 0, "contract").when(F.col("rows") == 0, "empty").when(age > stale_hours, "stale").when(F.abs(delta) > most_change * F.col("was"), "jump").otherwise("ok")
    return rows.select("dataset", "rows", delta.alias("delta"), F.round(age, 3).alias("age_hours"), status.alias("status"))


def describe(rows: DataFrame, vector: str | None = None) -> DataFrame:
    """What a manifest says of a table: one row of rows, columns, and lengths, least, largest and bad values of a vector column."""
    facts = [F.count(F.lit(1)).alias("rows"), F.lit(len(rows.columns)).alias("columns")]
    if vector:
        x = F.col(vector)
        bad = F.size(F.filter(x, lambda v: v.isNull() | F.isnan(v)))
        facts += [F.min(F.size(x)).alias("shortest"), F.max(F.size(x)).alias("longest"), F.min(F.array_min(x)).alias("low"), F.max(F.array_max(x)).alias("high"), F.sum(bad).alias("bad")]
    return rows.agg(*facts)


def file_digests(spark: SparkSession, path: str, text: bool = False, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of files; texts with line ends of one kind, so that systems agree."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    content = F.encode(F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n")), "UTF-8") if text else F.col("content")
    return rows.select("path", F.col("length").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def rebuild(rows: DataFrame, key: str, known_bad: dict[int, str], tokens: Column, lines: Column, flagged: Column, least_tokens: int = 10, least_lines: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and the others with the reason: known to be bad, too few tokens or lines, or mostly artifacts."""
    reason = F.lit(None).cast("string")
    reason = F.when(flagged, "artifact_ratio").otherwise(reason)
    reason = F.when(lines < least_lines, "too_few_lines").otherwise(reason)
    reason = F.when(tokens < least_tokens, "too_few_tokens").otherwise(reason)
    for bad, why in known_bad.items():
        reason = F.when(F.col(key) == bad, f"known_bad: {why}").otherwise(reason)
    told = rows.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def bad_rows(rows: DataFrame, contract: Contract) -> DataFrame:
    """Rows with the names of the checks that they fail."""
    found = checks(contract, rows.columns)
    names = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in found.items()]), lambda x: x.isNotNull())
    return rows.withColumn("checks", names).where(F.size("checks") > 0)


def report(found: DataFrame, title: str) -> str:
    """A report for people of (dataset, check, failures, examples): a bounded table of checks, not of rows."""
    rows = found.orderBy("dataset", "check").collect()
    bad = [r for r in rows if r.failures]
    out = [title, "=" * len(title), f"{len(rows)} checks, {len(bad)} failed"]
    out += [f"  {r.dataset}: {r.check} {r.failures}" + (f" (for example {', '.join(r.examples)})" if r.examples else "") for r in bad]
    return "\n".join(out)
