"""Queries on tables of many equal rows: what used to meet all pairs, or to depend on the order of rows."""

import pytest
from pyspark.sql import functions as F

from textforge.operators import fuzzy
from textforge.plans import registry


def test_pick_record_of_equal_rows(spark, tmp_path):
    """20,000 rows of one name and brand have 75 million pairs within 20 s; each wanted row gets the first record of its size's best."""
    rows = spark.range(20_000).select((F.col("id") + 1).alias("p_partkey"), F.lit("blue ring").alias("p_name"), F.lit("Brand#7").alias("p_brand"), (F.col("id") % 40 + 1).cast("int").alias("p_size"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got = {r.wanted: (r.record, r.score) for r in registry.QUERIES["pick_record"](spark, str(tmp_path)).collect()}
    # Sizes 1 to 10 want 7 to 70 seconds, sizes 11 to 40 offer 55 to 200; records of size s begin with id s.
    off = lambda w, s: abs(7 * w - 5 * s)
    want = {}
    for w in range(1, 11):
        near = [(off(w, s), s) for s in range(11, 41) if off(w, s) <= 20]
        if near:
            least, first = min(near)
            want |= {p: (first, 200.0 - least) for p in range(w, 20_001, 40)}
    assert got == want and len(got) == 3000


def test_pick_record_whatever_words_names_begin_with(spark, tmp_path):
    """Against all pairs: records whose first word is another, and best ones that a low title refuses."""
    names, brands = ["blue ring", "ring blue", "the blue ring", "red ring", "rings", None, "gear cold old", "old cold gear"], ["Brand#7", "Brand#71", "brand 7", None]
    rows = [(i, names[i * 5 % 8], brands[i * 3 % 7 % 4], i * 11 % 23 + 1) for i in range(120)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.wanted: (r.record, r.score) for r in registry.QUERIES["pick_record"](spark, str(tmp_path)).collect()}
    low, want, other = lambda x: (x or "").lower(), {}, 0
    for i, x, xb, xs in rows:
        near = [(fuzzy.token_set(low(x), low(y)) + fuzzy.indel(low(xb), low(yb)) - abs(7 * xs - 5 * ys), -j, y) for j, y, yb, ys in rows if ys > 10 and abs(7 * xs - 5 * ys) <= 20 and fuzzy.indel(low(xb), low(yb)) >= 80] if xs <= 10 else []
        if near and fuzzy.token_set(low(x), low(max(near)[2])) >= 75:
            want[i] = (-max(near)[1], round(max(near)[0], 4))
            other += low(x).split(" ")[0] != low(max(near)[2]).split(" ")[0]
    assert got == want and other > 3


def test_best_match_of_equal_names(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") == 7, "red").when(F.col("id") < 10, "red gear").otherwise("blue ring").alias("name"))
    rows = rows.union(spark.createDataFrame([(20_000, None), (20_001, ""), (20_002, "hot  rod"), (20_003, "lone")], "id long, name string"))
    side = lambda n: rows.select(F.col("id").alias(f"{n}_id"), F.col("name").alias(f"{n}_name"))
    got = {r.left_id: (r.right_id, r.score) for r in fuzzy.best_match(side("left"), side("right")).collect()}
    want = {i: (10 if i > 10 else 11, 100.0) for i in range(10, 20_000)} | {i: (0 if i else 1, 100.0) for i in range(10)}
    assert got == want


@pytest.mark.parametrize("names", [["a b", "a b", "a c", "b", "c c a", "d"], ["x y", "y x", "x", "y", "x y z", "x y"]])
def test_best_match_as_by_pairs(spark, names):
    rows = list(enumerate(names))
    want = {}
    for i, x in rows:
        near = [(-(x == y), -fuzzy.token_set(x, y), j) for j, y in rows if i != j and set(x.split()) & set(y.split()) and fuzzy.token_set(x, y) >= 60]
        if near:
            want[i] = min(near)[2]
    side = lambda n: spark.createDataFrame(rows, f"{n}_id long, {n}_name string")
    assert {r.left_id: r.right_id for r in fuzzy.best_match(side("left"), side("right")).collect()} == want


def test_attribution_sums_in_order(spark, tmp_path):
    """Long lines take many windows: sums by window, then by line, whatever order rows come in."""
    from textforge.operators import attribution

    labels, bias = ["joy", "sadness", "anger"], [-0.08, -0.12, 0.12]
    texts = [(k, "\n".join("x" * ((k * 37 + j * 91) % 700) for j in range(1 + k % 9))) for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    scores = [(k, i, ((k + i) % 10) / 10.0, ((k + 3 * i) % 7) / 7.0, 1 - ((k + i) % 10) / 10.0) for k, t in texts for i in range(1 if len(t) <= 80 else -((80 - len(t)) // 40) + 1)]
    want = {}
    for k, t in texts:
        own, at, rows = {r[1]: r[2:] for r in scores if r[0] == k}, 0, []
        for n, part in enumerate(t.split("\n"), 1):
            a, b, at = at, at + len(part), at + len(part) + 1
            over = [(i, min(i * 40 + 80, b) - max(i * 40, a)) for i in sorted(own) if min(i * 40 + 80, b) > max(i * 40, a)]
            if b > a:
                sums = [0.0] * 3
                for i, w in over:
                    sums = [s + w * x for s, x in zip(sums, own[i])]
                rows.append((n, a, b, [s / sum(w for _, w in over) + c for s, c in zip(sums, bias)]))
        if rows:
            want[k] = [(n, a, b, "neutral" if max(v) < 0.55 else labels[v.index(max(v))]) for n, a, b, v in rows]
    table = spark.createDataFrame(scores, "doc_id long, i long, joy double, sadness double, anger double").orderBy(F.desc("i"))
    got = {r.doc_id: [tuple(x) for x in r.lines] for r in attribution.attributed(docs, "doc_id", "text", table, labels, bias).collect()}
    assert got == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    digests = {r.doc_id: r.n_lines for r in registry.QUERIES["attribution_payload"](spark, str(tmp_path)).collect()}
    assert digests == {k: len(v) for k, v in want.items()}


def _against_sql(spark, tmp_path, name, **tables):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.execute(registry.ORACLE[name]).fetchall())


def test_audio_blend_as_in_sql_and_spread(spark, tmp_path):
    """Scores in steps of 1/128 round halves away from zero as in SQL; pairs of one file are dealt out to tasks, whichever way sides meet."""
    from textforge.operators import vectors

    rows = [(i - 300, [((i * 7 + j * 3) % 17 - 8) / 8 for j in range(4)] + [1 / 16], i % 3) for i in range(900)]
    _against_sql(spark, tmp_path, "audio_blend", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    items = spark.range(30_000).coalesce(1).select("id", F.array(F.col("id") % 7, F.lit(1)).cast("array<double>").alias("v"))
    queries = items.where("id % 100 = 0").selectExpr("id AS q_id", "v AS q")
    every = vectors.scored_pairs(queries, items, "q_id", "id")
    assert every.rdd.getNumPartitions() >= 5
    few, wide = queries.where("q_id < 600"), vectors.BROADCAST_MB
    try:
        sums = []
        for vectors.BROADCAST_MB in (wide, 0):
            sums.append(vectors.scored_pairs(few, items, "q_id", "id").agg(F.count("score"), F.sum("score")).first())
    finally:
        vectors.BROADCAST_MB = wide
    assert tuple(sums[0]) == tuple(sums[1]) == (180_000, float(sum((q % 7) * (i % 7) + 1 for q in range(0, 600, 100) for i in range(30_000))))


def test_similar_vectors_as_in_sql(spark, tmp_path):
    """Copies, one pair whose cosine is 9/20, and classes beyond one link."""
    import numpy as np

    draw = np.random.default_rng(3)
    v = [[float(x) for x in draw.integers(1, 9, 5) * draw.choice([-1, 1], 5)] for _ in range(60)] + [[1000.0, 0.0, 0.0, 0.0, 0.0], [-9.0, 17.0, 5.0, 2.0, 1.0], [-1000.0, 0.0, 0.0, 0.0, 0.0]]
    rows = [(3 * i + 1, x, i % 4) for i, x in enumerate(v + v[:9] + v[2:4])]
    _against_sql(spark, tmp_path, "similar_vectors", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def test_similar_vectors_of_one_large_group(spark, tmp_path):
    """6,000 vectors near one another have 18 million links: none is a row, and few jobs run."""
    near = [F.lit(1.0), F.col("id") / 1e5, F.lit(0.0), F.lit(0.0)]
    apart = [F.lit(0.0), F.lit(0.0), F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double"))]
    rows = spark.range(6003).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 6000, F.array(*near)).otherwise(F.array(*apart)).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("similar"))
    spark.sparkContext.setJobGroup("similar", "")
    try:
        got = {r.vec_id: (r.class_id, r.links) for r in registry.QUERIES["similar_vectors"](spark, str(tmp_path)).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Of the three others, a radian apart, those next to one another are linked.
    assert got == {i: (0, 5999) for i in range(6000)} | {6000: (6000, 1), 6001: (6000, 2), 6002: (6000, 1)}
    assert jobs() <= 30


@pytest.mark.parametrize("at_once", [0, 100])
def test_components_by_rounds_and_at_once(spark, at_once):
    from textforge.operators import graph

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 50), (50, 70), (80, 80)], "a long, b long")
    got = {r.node: r.group for r in graph.components(links, spark.range(90).withColumnRenamed("id", "node"), at_once=at_once).collect()}
    assert got == {i: 0 if i <= 40 else 50 if i in (50, 60, 70) else i for i in range(90)}


def test_compaction_of_titles_that_fold_alike(spark, tmp_path):
    titles = ["Groß", "Gross", "café", "café", "cafe", "Same", "same", "a\x0bb", "a b"]
    rows = [(i, f"{x}\n" + f"word{i // 2 * 2} " * 30, "en", ["src0", "src1", None, ""][i % 4 if i > 6 else 0], 200) for i, x in enumerate(titles)]
    _against_sql(spark, tmp_path, "compaction", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_titles_end_words_as_sql_does(spark, tmp_path):
    titles = ["Enkeit und inözutz bepf", "Erie inßverbe enöen", "Ab in cd", "öLyrics x", "A Lyrics"]
    rows = [(5 * i + j, "http://a/", f"<title>{x}</title>") for i, x in enumerate(titles) for j in range(5)]
    _against_sql(spark, tmp_path, "title_clean", pages=spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_nearest_as_by_pairs(spark):
    """Ties, copies, repeated ids, null vectors and batches of several blocks, against all pairs."""
    import numpy as np

    from textforge.operators import vectors

    draw = np.random.default_rng(5)
    v = [[float(x) for x in draw.integers(-2, 3, 3)] for _ in range(5000)]
    v[17], v[200] = None, [1.0, None, 2.0]
    rows = [(i if i != 4999 else 100, x, (i % 5) / 10) for i, x in enumerate(v)]
    items = spark.createDataFrame(rows, "id long, v array<double>, plus double").repartition(3)
    queries = items.where("id % 500 = 0 AND id < 2000").selectExpr("id AS q_id", "v AS q")
    dot = lambda a, b: None if a is None or b is None or None in a or None in b else sum(x * y for x, y in zip(a, b))
    asked = [(i, x) for i, x, _ in rows if i % 500 == 0 and i < 2000]
    for others, merge, weight, plus in ((True, False, 1.0, None), (False, False, 0.5, "plus"), (False, True, 1.0, None)):
        left = items.withColumn("id", F.expr("id DIV 4")) if merge else items
        got = vectors.nearest(queries, left, "q_id", "id", 7, 6, others, merge, weight, plus)
        if merge:
            got = got.groupBy("q_id", "id").agg(F.max("score").alias("score"))
        ranked = {}
        for r in got.collect():
            ranked.setdefault(r.q_id, []).append((-(r.score if r.score is not None else -1e9), r.id))
        for q, x in asked:
            near = [(-(weight * s + (p if plus else 0)) if s is not None else 1e9, i // 4 if merge else i) for i, y, p in rows if not (others and i == q) for s in [dot(x, y)]]
            if merge:
                best = {}
                for s, i in near:
                    best[i] = min(s, best.get(i, 1e9))
                near = [(s, i) for i, s in best.items()]
            assert [(round(s, 6), i) for s, i in sorted(ranked[q])[:7]] == [(round(s, 6), i) for s, i in sorted(near, key=lambda z: (round(z[0], 6), z[1]))[:7]]
    every = vectors.scored_pairs(queries, items, "q_id", "id").collect()
    assert len(every) == len(asked) * 5000 and sum(r.score is None for r in every) == 2 * len(asked)
