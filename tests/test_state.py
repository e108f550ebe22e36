"""Sources, sinks, versions, fetching, contracts, cleaning and matching on small tables."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from textforge.functions import cleaning as cl
from textforge.functions import unicode as un
from textforge.operators import assets, fuzzy, graph, health, quality, similar, state
from textforge.sources import adapters, fetch, files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_versions_are_ordered_by_publishing(spark, tmp_path):
    v = files.Versions(spark, f"{tmp_path}/v")
    for name in ("8", "9", "10", "11"):
        v.publish({"t": spark.range(int(name))}, name)
    assert v.versions() == ["9", "10", "11"] and v.current() == "11" and v.previous() == "10" and v.read("t").count() == 11
    v.rollback(verify=True)
    assert v.current() == "10" and v.manifest("10")["tables"]["t"]["rows"] == 10
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/v/versions/9/t")
    with pytest.raises(ValueError, match="differs"):
        v.rollback("9", verify=True)
    assert v.current() == "10"
    spark.range(2).write.parquet(f"{tmp_path}/s/t")
    assert files.Versions(spark, f"{tmp_path}/none").read("t", staging=f"{tmp_path}/s").count() == 2


def test_files(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.savez(tmp_path / "p.npz", coef=np.ones((2, 3)), intercept=np.array([1.0, 2.0]))
    rows = files.read_arrays(spark, f"{tmp_path}/*.np?").collect()
    assert sorted((r.name, r.row, tuple(r["values"])) for r in rows) == [("", 0, (0.0, 1.0)), ("", 1, (2.0, 3.0)), ("", 2, (4.0, 5.0)), ("coef", 0, (1.0,) * 3), ("coef", 1, (1.0,) * 3), ("intercept", 0, (1.0,)), ("intercept", 1, (2.0,))]
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, "y")])
    assert sorted(map(tuple, files.read_sqlite(spark, f"{tmp_path}/x.db", "SELECT a, b FROM t", "a long, b string").collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "d.json").write_text(json.dumps({"items": [{"a": 1}, {"a": 2}]}))
    assert [r.a for r in files.read_json_document(spark, f"{tmp_path}/d.json", "items array<struct<a: long>>", "items").collect()] == [1, 2]
    files.write_one_csv(spark.createDataFrame([(1, 'a "b"\nc')], "k long, t string"), f"{tmp_path}/o.csv")
    files.write_one_csv(spark.createDataFrame([(2, "x")], "k long, t string"), f"{tmp_path}/o.csv")
    assert files.read_text_rows(spark, f"{tmp_path}/o.csv").collect() == [("2", "x")]
    assert files.write_array(spark.createDataFrame([(2, [3.0]), (1, [1.0])], "k long, v array<double>"), "k", "v", f"{tmp_path}/w.npy") == 2
    assert np.load(tmp_path / "w.npy").tolist() == [[1.0], [3.0]]
    digests = {files.snapshot(spark.range(n).repartition(n), f"{tmp_path}/snap", f"2024-0{n}", keep=2) for n in (1, 2, 3)}
    assert len(digests) == 3 and sorted(p.name for p in (tmp_path / "snap").iterdir() if p.name[0] != ".") == ["2024-02", "2024-02.sha256", "2024-03", "2024-03.sha256"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes(b"x\r\ny\n")
    (tmp_path / "t/b.txt").write_bytes(b"x\ny\n")
    assert len({r.sha256 for r in health.file_digests(spark, f"{tmp_path}/t", text=True).collect()}) == 1
    assert one(spark, files.locations(F.col("t")), t="<loc> http://b </loc><a href='http://a'>x</a><loc>http://b</loc>") == ["http://a", "http://b"]
    known = spark.createDataFrame([("k1", F.lit(None)._jc and None), ("k2", "s")], "key string, sha string")
    new = spark.createDataFrame([("k1", "t" * 200), ("k2", "u" * 200), ("k3", "t" * 200), ("k4", "short")], "key string, lyrics string")
    got = files.import_corpora(known, [(new, "src", "one")], F.md5("lyrics"), F.lit("romanized")).collect()
    assert [(r.key, r.source) for r in got] == [("k1", "src")]


def test_fetch(spark, tmp_path):
    calls, answers, now = [], [(503, ""), (200, '{"a": 1}'), (404, ""), (500, ""), (500, ""), (500, "")], [0.0]
    c = fetch.Cached(lambda u, p: (calls.append(u), answers.pop(0))[1], str(tmp_path), attempts=3, failures=3, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0], interval=1.0)
    assert c.json("http://h/x", {"b": 2, "a": 1}) == {"a": 1} == c.json("http://h/x", {"a": 1, "b": 2}) and len(calls) == 2
    assert c.text("http://h/y") is None
    with pytest.raises(fetch.Unavailable):
        c.text("http://h/z")
    n = len(calls)
    with pytest.raises(fetch.Unavailable):
        c.text("http://h/z")
    assert len(calls) == n == 6 and now[0] > 3
    assert list(fetch.pages(lambda i: [1, 2] if i < 3 else [3], 2)) == [1, 2, 1, 2, 3]
    rows = fetch.catalog(spark, [{"id": 1, "title": "t", "artist": {"name": "a"}, "duration": 9}, {"trackId": 2, "trackName": "u", "artistName": "b", "trackTimeMillis": 5000}, {"id": 3}], "s").collect()
    assert [(r.source_id, r.artist, r.duration_s) for r in rows] == [("1", "a", 9), ("2", "b", 5)]


def test_contracts(spark):
    rows = spark.createDataFrame([(1, "a", 3), (1, " ", -1), (2, "b", None)], "k long, t string, n long")
    c = quality.Contract("x", {"k": quality.Field("int", nullable=False), "t": quality.Field("str", nullable=False), "n": quality.Field("int", least=0), "gone": quality.Field("str")}, key=("k",))
    got = {r.check: (r.failures, r.examples) for r in quality.validate(rows, c).collect()}
    assert got["t:not_null"] == (1, ["1"]) and got["n:minimum"] == (1, ["1"]) and got["key:unique"] == (2, ["1"]) and got["columns:missing"] == (1, ["gone"]) and got["k:not_null"] == (0, [])
    assert len(health.CONTRACTS) == 9
    found = health.validate_all({"audio_new_songs": rows, "mood_labels": None}, strict=True)
    text = health.report(found, "Datasets")
    assert "mood_labels: dataset:missing 1" in text and text.startswith("Datasets\n========\n")
    assert quality.validate(rows.limit(0), c).where("failures > 0").select("check").collect() == [("columns:missing",)]


def test_state(spark):
    old = spark.createDataFrame([(0,), (1,)], "owner int")
    assert sorted(r.owner for r in state.appended(old, spark.createDataFrame([(0,), (0,), (1,)], "owner int"), "owner").collect()) == [0, 1, 2, 2, 3]
    corpus = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    done = spark.createDataFrame([(1, "a")], "id long, digest string")
    rows, same = state.tail(corpus, done, "id", F.col("t"))
    assert same and [r.id for r in rows.collect()] == [2]
    assert not state.tail(corpus, spark.createDataFrame([(1, "x")], "id long, digest string"), "id", F.col("t"))[1]
    mark = state.watermark(corpus, json.dumps({"rows": 1}), "d", "2024")
    assert json.loads(mark) == {"rows": 2, "new_songs": 1, "digest": "d", "updated_at": "2024"}


def test_titles_and_lines(spark):
    title = lambda t: one(spark, cl.clean_title(un.tidy(F.col("t"))), t=t)
    assert title("Lyrics of  Maya from Film") == "Maya" and title("Sun Lyrics and Chords - site") == "Sun" and title("Lyrics") == "Lyrics"
    assert title("Rain (Romanized)") == "Rain" and title("“Rain”​, Nepali Song") == '"Rain"'
    text = "[Chorus]\n12 Contributors\nRain\nRain falls down here\nfalls (softly) on ♪ me #tag\n'so it goes'\nLyrics: Someone\nDirector - X\nsubscribe to the channel\n\nEmbed\nBob\nlast line https://x.y"
    rows = spark.createDataFrame([(text, "Rain", "Bob & Al")], "t string, title string, artist string").withColumn("titles", cl.title_variants(F.col("title"))).withColumn("artists", cl.artist_variants(F.col("artist")))
    got = rows.withColumn("l", cl.clean_lines(F.col("t"), F.col("titles"), F.col("artists"), F.col("artist"))).select(cl.body_of(F.col("l")).alias("body"), cl.actions_of(F.col("l")).alias("actions")).first()
    assert got.body == "falls on me\nso it goes\nlast line" and len(got.actions) == 9 and all(a.startswith("removed_") for a in got.actions)
    assert one(spark, F.array_join(cl.collapse_blank(F.split("t", "\n")), "|"), t="\n\na\n \n\nb\n\n") == "a||b"
    assert one(spark, cl.without_stamps(F.col("t")), t="[00:12.34] a\n\n[1:02]b\n作词 x\n日本\nमा 日") == "a\nb\nमा 日"
    assert one(spark, cl.native_ratio(F.col("t")), t="timi mero maya ho\nyou and I are in the rain\nla la") == 0.5 and one(spark, cl.native_ratio(F.col("t")), t="") == 1.0
    assert one(spark, cl.accepted(F.col("t"), F.lit("romanized")), t="mero maya " * 20) == "ok" and one(spark, cl.accepted(F.col("t"), F.lit("romanized")), t="hello there " * 20) == "script_rejected:romanized"
    assert one(spark, cl.without_chords(F.col("t")), t="Am | G7  C/E\nwords stay\nCapo") == "words stay"
    assert one(spark, F.array_join(cl.without_tail(F.split("t", " "), "^x"), " "), t="a b xx c") == "a b" and one(spark, F.array_join(cl.after_last(F.split("t", " "), "^x"), " "), t="a x b x c") == "c"


def test_tracks_and_words(spark):
    assert one(spark, cl.track_key(F.lit("A, B"), F.col("t")), t="Rain (Official Video) 2019 | x") == "a b|rain"
    assert one(spark, cl.primary_artist(F.col("t")), t="Bob feat. Al & Cy") == "Bob"
    assert tuple(one(spark, cl.file_name_parts(F.col("t")), t="/m/Bob - Rain - live.mp3")) == ("Bob", "Rain - live") and tuple(one(spark, cl.file_name_parts(F.col("t")), t="Rain.mp3.mp3")) == ("", "Rain")
    bucket = lambda a, b, has, t: one(spark, cl.match_bucket(F.col("a"), F.col("b"), F.col("h"), F.col("t")), a=a, b=b, h=has, t=t)
    assert [bucket(95.0, 0.0, False, "maya"), bucket(95.0, 0.0, False, "long road home"), bucket(90.0, 85.0, True, "x"), bucket(0.0, 90.0, True, "x"), bucket(0.0, 0.0, True, "x")] == ["probable", "strong", "strong", "weak", "none"]
    verdict = lambda a, b, n: one(spark, cl.lyric_verdict(F.col("a"), F.col("b"), F.col("n")), a=a, b=b, n=n)
    assert [verdict(68.0, 0.0, 0.0), verdict(50.0, 0.0, 0.1), verdict(50.0, 0.0, 0.9), verdict(0.0, 0.0, 0.9)] == ["lyrics_confirmed", "new_lyrics_non_native", "lyrics_ambiguous_linked", "new_lyrics"]
    assert one(spark, cl.pair_form(F.col("t")), t="Maayaaaa (x) cha--sha ") == "maaya chha sa"
    assert one(spark, cl.kept_english(F.split("t", " "), ["love", "run", "it"]), t="loves it s running loved maya") == [True, True, True, True, True, False]
    assert one(spark, un.skeleton(F.col("t")), t="मा‍या") == "मय"
    assert one(spark, un.composed(F.col("t")), t="काे") == "को"
    assert one(spark, cl.english_prose(F.col("t"), ["वाच"]), t="वाच " * 7 + "x") is True


def test_similarity_joins(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    v = np.concatenate([base + 0.2 * rng.normal(size=base.shape) for _ in range(9)])
    v[5] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    norm = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    exact = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if norm[i] @ norm[j] >= 0.9}
    got = similar.cosine_links(rows, "k", "v", 0.9, pivots=5)
    assert {(r.a, r.b) for r in got.collect()} == exact and len(exact) > 50
    groups = {r.node: r.group for r in graph.components(got.select("a", "b"), rows.select(F.col("k").alias("node"))).collect()}
    assert all(groups[a] == groups[b] for a, b in exact) and all(groups[g] == g for g in groups.values()) and groups[5] == 5
    chain = graph.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), spark.range(62).withColumnRenamed("id", "node"))
    assert {(r.node, r.group) for r in chain.collect()} == {(i, 0) for i in range(61)} | {(61, 61)}
    names = spark.createDataFrame([(i, t) for i, t in enumerate(["the long road home", "the long road homes", "a different title", "the long road home", "xy"])], "k long, t string")
    assert [(r.a, r.b) for r in similar.minhash_pairs(names, "k", "t", 4, 0.6).collect()] == [(0, 1)]
    assert fuzzy.weighted("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(95.0) and fuzzy.weighted("", "x") == 0.0


def test_sites(spark, tmp_path):
    pair = lambda t: tuple(one(spark, adapters.title_artist(F.col("t")), t=t))
    assert [pair("Rain Lyrics by Bob"), pair("Rain | Bob | Site"), pair("Rain - Bob Lyrics & Chords"), pair("Rain - Lyrics"), pair("Rain  Lyrics")] == [("Rain", "Bob"), ("Rain", "Bob"), ("Rain", "Bob"), ("Rain", ""), ("Rain", "")]
    assert one(spark, adapters.slug_title(F.col("t")), t="https://x.org/a/quiet-rain_lyrics.html?x=1") == "Quiet Rain"
    may = lambda u: one(spark, adapters.allowed(F.col("t"), ["x.org"], "/song/", ["/tag"]), t=u)
    assert [may("https://X.org/song/a"), may("https://x.org/song/tag/a"), may("https://y.org/song/a"), may("no address")] == [True, False, False, False]

    @adapters.register("x.org")
    class Site:
        domain = "x.org"

        def discover(self, client):
            yield from (f"https://x.org/{i}" for i in (2, 1, 2, 3))

        def parse(self, pages):
            return adapters.page_lines(pages)

    client = fetch.Cached(lambda u, p: (404, "") if u.endswith("3") else (200, f"<p>{u}</p><p>b</p>"), str(tmp_path))
    assert [(r.url, r.lines) for r in adapters.crawl(spark, "x.org", client).orderBy("url").collect()] == [(f"https://x.org/{i}", [f"https://x.org/{i}", "b"]) for i in (1, 2)]
    with pytest.raises(ValueError):
        adapters.register("x.org")(Site)


def test_runs(spark):
    assert assets.script(["echo", "hi"])() == "hi\n"
    with pytest.raises(RuntimeError, match="ended with 1"):
        assets.script(["false"])()
    log = spark.createDataFrame([], "run string, asset string, status string, at string")
    log = assets.history(assets.history(log, {"a": "failed", "b": "ok"}, "r1", "2024-01"), {"a": "ok"}, "r2", "2024-02")
    assert sorted(map(tuple, assets.last_statuses(log).collect())) == [("a", "ok", "2024-02", "2024-01"), ("b", "ok", "2024-01", None)]
    words = spark.range(200).select(F.lit("reading").alias("w"), F.col("id"))
    got = words.select(un.noisy("w", "id").alias("x")).distinct().collect()
    assert len(got) > 20 and all(fuzzy.indel("reading", r.x) > 75 for r in got)
