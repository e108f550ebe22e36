"""Entry points, the vector index, set cover, typing errors and numbering on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textforge.operators import ann, assets, attribution, cover, retrieval, vectors
from textforge.operators.numbering import numbered
from textforge.service import Recent, Service, clamp


@pytest.fixture(scope="module")
def service(spark):
    songs = [(1, "Rain", "Bob", "rain falls on the quiet town tonight"), (2, "Rainbow", "Al", "colours over the quiet river"), (3, "Sun", "Bob", "sun over the river and the hills"), (4, "Copy", "Cy", "Rain falls on the quiet town, tonight!"), (5, "Moon", None, "")]
    vectors_ = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [-1.0, 0.0])]
    moods = [(i, i / 10, 1 - i / 10) for i in range(1, 7)]
    return Service(spark.createDataFrame(songs, "song_id long, title string, artist string, lyrics string"), spark.createDataFrame(vectors_, "song_id long, v array<double>"), spark.createDataFrame(moods, "song_id long, joy double, sadness double"), ["joy", "sadness"], encode=lambda t: [1.0, 0.0])


def ids(df):
    return [r.song_id for r in df.orderBy("rank").collect()]


def test_search(service):
    assert ids(service.lexical("quiet town tonight falls")) == [1, 4, 2] and ids(service.lexical("the")) == [] and ids(service.lexical("zzz yyy xxx")) == []
    assert ids(service.by_text("bob"))[:2] == [1, 3] and len(ids(service.by_text("bob"))) == 2
    assert ids(service.by_text("quiet town tonight falls"))[0] == 1 and 4 not in ids(service.by_text("quiet town tonight falls"))
    rows = service.search("rain", 3).orderBy("rank").collect()
    assert [(r.song_id, r.kind) for r in rows[:2]] == [(1, "title"), (2, "title")] and len(rows) == 3
    assert ids(service.by_song(1)) == [4, 2, 3, 5]
    audio = service.songs.sparkSession.createDataFrame([(1, [0.0, 1.0]), (3, [0.0, 1.0])], "song_id long, v array<double>")
    assert ids(service.by_song(1, 2, audio)) == [4, 2] and ids(service.by_song(2, 9, audio)) == ids(service.by_song(2, 9))
    tracks = service.songs.sparkSession.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.9, 0.1], None), ("c", [0.0, 1.0], 3)], "track_key string, v array<double>, song_id long")
    assert [(r.track_key, r.song_id) for r in service.by_track(tracks, "a", tracks).orderBy("rank").collect()] == [("b", None), ("c", 3)]
    assert service.cache.hits > 0


def test_moods(service, spark):
    assert ids(service.neighbours(1, 2)) == [2, 3] and len(ids(service.neighbours(1, 99))) == 5 and [r.title for r in service.neighbours(5, 1).collect()] in (["Copy"], [""])
    assert ids(service.mood_top("joy", 0)) == [6] and [r.title for r in service.mood_top("joy", 1).collect()] == [""]
    with pytest.raises(ValueError):
        service.mood_top("fear")
    windows = lambda df: df.select("song_id", F.lit(0).cast("long").alias("i"), F.lit(0.9).alias("joy"), F.lit(0.2).alias("sadness"))
    got = service.analyze(" first line\n\nlast ", windows, [0.0, 0.0])
    assert got["input"] == {"original": " first line\n\nlast ", "script": "romanized"} and [(x["line"], x["a"], x["b"], x["label"]) for x in got["lines"]] == [(1, 0, 10, "joy"), (3, 12, 16, "joy")]
    assert got["polarity_label"] == "positive" and got["composition"] == {"joy": 0.8182, "sadness": 0.1818}
    assert service.song(99, windows(service.songs), [0.0, 0.0]) is None and service.song(1, windows(service.songs), [0.0, 0.0])["song_id"] == 1
    gold = spark.createDataFrame([(1, "joy"), (2, "sadness")], "song_id long, gold string")
    payload = attribution.attributed(service.songs, "song_id", "lyrics", windows(service.songs), ["joy", "sadness"], [0.0, 0.0])
    assert tuple(attribution.gate(payload, gold, "song_id", ["joy", "sadness"]).first()) == (2, 0.5, False)
    assert attribution.slim(payload, "song_id", ["joy", "sadness"]).columns == ["song_id", "joy", "sadness"]
    assert service.status() == {"songs": 5, "vectors": 5, "moods": 6} and clamp(99, 1, 25) == 25


def test_windows_reach_the_end(spark):
    for n in (0, 1, 80, 81, 120, 121, 400):
        w = spark.range(1).select(attribution.spans(F.lit("x" * n)).alias("w")).first().w
        assert w[-1].b == n and all(x.a == 40 * i for i, x in enumerate(w)) and all(b.a < a.b for a, b in itertools.pairwise(w))


def test_index(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    x = np.concatenate([m + 0.3 * rng.normal(size=(40, 16)) for m in middle])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    at = ann.centres(rows, "k", "v", 12)
    index = ann.build(rows, "k", "v", at)
    assert index.count() == len(x)
    q = rows.where("k % 20 = 0").select(F.col("k").alias("q"), F.col("v").alias("w"))
    exact = retrieval.top_k(vectors.score_all(q.select("q", vectors.unit(F.col("w")).alias("q_")).withColumnsRenamed({"q": "id", "q_": "q"}), rows.select("k", vectors.unit(F.col("v")).alias("v")), "id", "k").withColumn("score", F.round("score", 6)), "id", "k", "score", 10).withColumnRenamed("id", "q")
    assert ann.recall(ann.search(index, q, at, "k", "q", "w", 10, 3), exact, "q", "k").first().recall >= 0.9
    assert ann.recall(ann.search(index, q, at, "k", "q", "w", 10, 12), exact, "q", "k").first().least == 1.0
    assert ann.kind(10) == "flat" and ann.kind(50_000) == "cells" and ann.kind(10, "cells") == "cells"


def test_cover_and_typos(spark):
    r = random.Random(1)
    lines = {i: [f"w{r.randrange(30)}" for _ in range(r.randint(1, 8))] for i in range(40)}
    weight = {f"w{i}": float(r.randint(1, 9)) for i in range(30)}
    covered, plain = set(), []
    for _ in range(12):
        best = max(lines, key=lambda i: (sum(weight[t] for t in set(lines[i]) - covered), -i))
        if sum(weight[t] for t in set(lines[best]) - covered) <= 0:
            break
        plain.append(best)
        covered |= set(lines[best])
    assert cover.greedy_cover(lines, weight, 12) == plain
    tokens, phrases = cover.typo_maps([("token", "teh", "the"), ("phrase", "a b", "x"), ("phrase", "a b c", "y z"), ("token", "", "q"), ("token", "s", "s")])
    assert tokens == {"teh": "the"} and phrases == {"a b": "x", "a b c": "y z"}
    row = spark.range(1).select(cover.map_phrases(F.split(F.lit("a b a b c a b ab"), " "), phrases).alias("p"), cover.map_tokens(F.split(F.lit("teh tehs"), " "), tokens).alias("t"), cover.map_text(F.lit("teh, tehs a.teh"), tokens).alias("x")).first()
    assert row.p == ["x", "y", "z", "x", "ab"] and row.t == ["the", "tehs"] and row.x == "the, tehs a.the"
    may = F.create_map(F.lit("teh"), F.lit(False))
    assert spark.range(1).select(cover.map_tokens(F.split(F.lit("teh"), " "), tokens, may).alias("t")).first().t == ["teh"]
    recent = Recent(str.upper, 2)
    assert [recent(t) for t in ("a", " A", "b", "c", "a")] == ["A", "A", "B", "C", "A"] and recent.hits == 1


def test_numbers_and_intervals(spark):
    keys = random.Random(5).sample(range(10**9), 3000)
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    got = {r.k: r.number for r in numbered(rows, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))} and numbered(rows.limit(0), "k").count() == 0
    x = [(i, float(v)) for i, v in enumerate(np.random.default_rng(1).normal(0.3, 1, 400))]
    df = spark.createDataFrame(x, "k long, x double")
    one, again = (assets.paired_bootstrap(d, "k").first() for d in (df, df.repartition(3)))
    mean, se = np.mean([v for _, v in x]), np.std([v for _, v in x]) / 20
    assert one == pytest.approx(again) and one.n == 400 and one.positive == pytest.approx(np.mean([v > 0 for _, v in x]))
    assert one.low == pytest.approx(mean - 1.96 * se, abs=0.2 * se) and one.high == pytest.approx(mean + 1.96 * se, abs=0.2 * se)


def test_mmr_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(q, i, float(rng.random()), rng.normal(size=4).tolist()) for q in range(2) for i in range(9)]
    got = retrieval.mmr(spark.createDataFrame(rows, "q long, i long, score double, v array<double>"), "q", "i", "score", "v", 5).collect()
    for q in range(2):
        mine = [(i, s, np.array(v) / np.linalg.norm(v)) for p, i, s, v in rows if p == q]
        low, high = min(s for _, s, _ in mine), max(s for _, s, _ in mine)
        chosen = []
        while len(chosen) < 5:
            left = [m for m in mine if m[0] not in [c[0] for c in chosen]]
            chosen.append(max(left, key=lambda m: 0.7 * (m[1] - low) / (high - low) - 0.3 * max((float(m[2] @ c[2]) for c in chosen), default=0.0)))
        assert [r.i for r in sorted(got, key=lambda r: r["rank"]) if r.q == q] == [c[0] for c in chosen]
