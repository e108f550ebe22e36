"""The library's entry points as functions of tables: search, songs, neighbours, moods, events, analysis, figures and status.

Answers are DataFrames, or small dictionaries of what one request shows.  A web server, if any, is the caller's.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.functions import text as tx
from textforge.functions import unicode as un
from textforge.operators import attribution
from textforge.operators import events as ev
from textforge.operators import retrieval as r
from textforge.operators import vectors as v


class Recent:
    """The last ``size`` results of a function of text, by the text with single blanks in lower case."""

    def __init__(self, make: Callable[[str], object], size: int = 512):
        self.make, self.size, self.kept, self.hits = make, size, OrderedDict(), 0

    def __call__(self, text: str):
        key = " ".join(text.lower().split())
        if key in self.kept:
            self.kept.move_to_end(key)
            self.hits += 1
        else:
            self.kept[key] = self.make(text)
            while len(self.kept) > self.size:
                self.kept.popitem(last=False)
        return self.kept[key]


def clamp(k: int, least: int, most: int) -> int:
    return max(least, min(int(k), most))


@dataclass
class Service:
    """``songs``: song_id, title, artist, lyrics.  ``vectors``: song_id, v.  ``moods``: song_id and a column for each of ``labels``."""

    songs: DataFrame
    vectors: DataFrame
    moods: DataFrame
    labels: list[str]
    encode: Callable[[str], list[float]] | None = None
    stop: frozenset[str] = frozenset()
    cache: Recent | None = field(default=None)

    def __post_init__(self):
        if self.encode is not None and self.cache is None:
            self.cache = Recent(self.encode)

    def _one(self, text: str) -> DataFrame:
        return self.songs.sparkSession.createDataFrame([(0, text)], "q long, text string")

    def lexical(self, text: str, k: int = 10, gate: bool = True) -> DataFrame:
        """(song_id, score, rank) by BM25; empty if the query is too common to tell, or nothing scores above 0."""
        query = self._one(text)
        scores = r.bm25(self.songs, query, "song_id", "lyrics", "q", "text", words=64).where("score > 0")
        if gate and not self.telling(text):
            scores = scores.where("false")
        return r.top_k(scores.withColumn("score", F.round("score", 6)), "q", "song_id", "score", k).select("song_id", "score", "rank")

    def telling(self, text: str, least: int = 2, idf: float = 2.5) -> bool:
        """Whether a query has enough known tokens: three, or two of which one is native and none common."""
        tokens = self._one(text).select(F.explode(tx.tokens(F.col("text"))).alias("term"))
        n = self.songs.agg(F.count(F.lit(1)).alias("n"))
        post = r.postings(self.songs, "song_id", "lyrics").join(tokens.distinct(), "term", "left_semi")
        row = tokens.join(r.term_stats(post, n), "term").agg(F.count(F.lit(1)).alias("known"), F.min("idf").alias("low"), F.bool_or(F.col("term").rlike("[\\x{0900}-\\x{097F}]")).alias("native")).first()
        return row.known > least or (row.known == least and bool(row.native) and row.low >= idf)

    def candidates(self, scores: DataFrame, allowed: DataFrame | None, seed: int | None, k: int) -> DataFrame:
        """The ``k`` best: among ``allowed`` only if that's given, never the seed itself, equal texts once, at their best place."""
        if allowed is not None:
            scores = scores.join(allowed.select("song_id"), "song_id", "left_semi")
        if seed is not None:
            scores = scores.where(F.col("song_id") != seed)
        norm = F.array_join(tx.tokens(F.col("lyrics")), " ")
        texts = self.songs.select("song_id", F.when(norm == "", F.concat(F.lit("id:"), F.col("song_id"))).otherwise(F.md5(norm.cast("binary"))).alias("text"))
        best = scores.join(texts, "song_id").groupBy("text").agg(F.max(F.struct("score", (-F.col("song_id")).alias("id"))).alias("m"))
        return r.top_k(best.select(F.lit(0).alias("q"), (-F.col("m.id")).alias("song_id"), F.col("m.score").alias("score")), "q", "song_id", "score", k).select("song_id", "score", "rank")

    def by_text(self, text: str, k: int = 10) -> DataFrame:
        """Dense and lexical scores fused; dense ones alone if the query is too common, lexical ones alone without an encoder.
        A query that is an artist's name ranks only that artist's songs."""
        artist = self.songs.where(un.nfc(F.lower("artist")) == text.strip().lower())
        allowed = artist if not artist.isEmpty() else None
        lexical = r.bm25(self.songs, self._one(text), "song_id", "lyrics", "q", "text", words=64).select("song_id", F.col("score").alias("lexical")) if self.telling(text) else None
        if self.encode is None:
            return self.lexical(text, k) if lexical is None or allowed is None else self.candidates(lexical.withColumnRenamed("lexical", "score"), allowed, None, k)
        q = F.array(*[F.lit(float(x)) for x in self.cache(text)])
        dense = self.vectors.select("song_id", v.dot(q, F.col("v")).alias("dense"))
        if lexical is None:
            return self.candidates(dense.withColumnRenamed("dense", "score"), allowed, None, k)
        fused = r.fuse(dense.join(lexical, "song_id", "full").withColumn("q", F.lit(0)), "q", "dense", "lexical")
        return self.candidates(fused.select("song_id", F.round("fused", 6).alias("score")), allowed, None, k)

    def by_song(self, song_id: int, k: int = 10, audio: DataFrame | None = None) -> DataFrame:
        """Songs like a song by vectors; where both have audio vectors, half of the score is theirs."""
        scores = self._like(self.vectors, song_id, "text")
        if audio is None:
            return self.candidates(scores.withColumnRenamed("text", "score"), None, song_id, k)
        both = scores.join(self._like(audio, song_id, "audio"), "song_id", "left")
        score = F.coalesce(0.5 * F.col("text") + 0.5 * F.col("audio"), F.col("text"))
        return self.candidates(both.select("song_id", score.alias("score")), None, song_id, k)

    def by_track(self, audio: DataFrame, key: str, tracks: DataFrame, k: int = 10) -> DataFrame:
        """Tracks like a track by audio alone: track_key, song_id (if the track has one), score, rank.  ``audio``: track_key, v."""
        seed = audio.where(F.col("track_key") == key).select(F.col("v").alias("q"))
        scores = audio.join(F.broadcast(seed), F.lit(True)).where(F.col("track_key") != key).select(F.lit(0).alias("q0"), "track_key", F.round(v.dot(F.col("q"), F.col("v")), 6).alias("score"))
        top = r.top_k(scores, "q0", "track_key", "score", k)
        return top.join(tracks.select("track_key", "song_id"), "track_key", "left").select("track_key", "song_id", "score", "rank")

    @staticmethod
    def _like(vectors: DataFrame, song_id: int, name: str) -> DataFrame:
        seed = vectors.where(F.col("song_id") == song_id).select(F.col("v").alias("q")).limit(1)
        return vectors.join(F.broadcast(seed), F.lit(True)).select("song_id", v.dot(F.col("q"), F.col("v")).alias(name))

    def search(self, text: str, limit: int = 12) -> DataFrame:
        """Hits in titles and artists first, those that begin with the query before others, then by text: song_id, title, artist, kind, rank."""
        limit, q = clamp(limit, 1, 50), text.strip().lower()
        names = self.songs.select("song_id", "title", "artist", F.lower("title").alias("t"), F.lower(F.coalesce("artist", F.lit(""))).alias("a"))
        hits = names.where((F.lit(q) != "") & (F.contains("t", F.lit(q)) | F.contains("a", F.lit(q)))).withColumn("place", F.when(F.startswith("t", F.lit(q)), 0).otherwise(1)).orderBy("place", "t", "song_id").limit(limit)
        named = hits.select("song_id", "title", "artist", F.lit("title").alias("kind"), F.col("place").cast("double").alias("o1"), F.col("t").alias("o2"))
        more = self.by_text(text, limit).join(hits.select("song_id"), "song_id", "left_anti").join(self.songs.select("song_id", "title", "artist"), "song_id")
        rows = named.unionByName(more.select("song_id", "title", "artist", F.lit("lyrics").alias("kind"), (F.col("rank") + 10).cast("double").alias("o1"), F.lit("").alias("o2")))
        rows = rows.orderBy("o1", "o2", "song_id").limit(limit).withColumn("q", F.lit(0))
        from pyspark.sql import Window

        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("o1", "o2", "song_id"))).select("song_id", "title", "artist", "kind", "rank")

    def song(self, song_id: int, windows: DataFrame, bias: list[float]) -> dict | None:
        """One song's payload; None for an unknown one."""
        rows = self.songs.where(F.col("song_id") == song_id).select("song_id", "lyrics")
        found = attribution.attributed(rows, "song_id", "lyrics", windows, self.labels, bias).first()
        return found.asDict(recursive=True) if found else None

    def analyze(self, text: str, scored: Callable[[DataFrame], DataFrame], bias: list[float]) -> dict:
        """The payload of a text that isn't in the corpus; ``scored`` gives its windows' scores.  Also what the input was."""
        row = self._one(text).select(F.col("q").alias("song_id"), un.tidy(F.col("text")).alias("lyrics"))
        found = attribution.attributed(row, "song_id", "lyrics", scored(row), self.labels, bias).first()
        script = row.select(tx.script(F.col("lyrics")).alias("s")).first().s
        return {"input": {"original": text, "script": script}, **({k: x for k, x in found.asDict(recursive=True).items() if k != "song_id"} if found else {"lines": []})}

    def neighbours(self, song_id: int, k: int = 8) -> DataFrame:
        """Songs of the nearest moods: title and artist are empty where unknown."""
        gap = lambda c: (F.col(c) - F.col(f"q_{c}")) * (F.col(c) - F.col(f"q_{c}"))
        seed = self.moods.where(F.col("song_id") == song_id).select(*[F.col(c).alias(f"q_{c}") for c in self.labels]).limit(1)
        rows = self.moods.where(F.col("song_id") != song_id).join(F.broadcast(seed), F.lit(True))
        scored = rows.select(F.lit(0).alias("q"), "song_id", F.round(1 / (1 + F.sqrt(sum((gap(c) for c in self.labels), F.lit(0.0)))), 4).alias("score"))
        return self._named(r.top_k(scored, "q", "song_id", "score", clamp(k, 1, 25)))

    def mood_top(self, label: str, k: int = 10) -> DataFrame:
        if label not in self.labels:
            raise ValueError(f"unknown mood {label}")
        return self._named(r.top_k(self.moods.select(F.lit(0).alias("q"), "song_id", F.col(label).alias("score")), "q", "song_id", "score", clamp(k, 1, 50)))

    def _named(self, top: DataFrame) -> DataFrame:
        names = self.songs.select("song_id", "title", "artist")
        return top.join(names, "song_id", "left").select("song_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("artist", F.lit("")).alias("artist"), "score", "rank")

    @staticmethod
    def events(batch: DataFrame, kinds: list[str], now: str, most: int = 200) -> tuple[DataFrame, DataFrame]:
        """Accepted and refused events of one batch, the latter with reasons; ValueError for batches too large or all refused."""
        n = batch.count()
        if not 1 <= n <= most:
            raise ValueError(f"a batch has 1 to {most} events")
        told = batch.withColumn("reason", ev.reason(kinds, now))
        good = told.where("reason IS NULL").drop("reason")
        if good.isEmpty():
            raise ValueError("no event was accepted")
        return good, told.where("reason IS NOT NULL")

    def status(self) -> dict:
        """Rows of each table."""
        return {name: df.count() for name, df in (("songs", self.songs), ("vectors", self.vectors), ("moods", self.moods))}
