"""Library operators on small tables, and every registered query against its SQL."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textforge.functions import text as tx
from textforge.operators import assets, fuzzy, queues, retrieval
from textforge.plans import registry
from textforge.sources import files
from textforge.streaming import events as stream

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_texts(spark):
    assert one(spark, tx.fold(F.col("t")), t="  Straße -- NO. 1_a ") == "strasse no 1_a"
    assert one(spark, tx.tokens(F.col("t")), t="Ab c1, é मा x") == ["ab", "c1", "मा", "x"]
    assert one(spark, tx.seconds(F.col("t")), t="1:02:03") == 3723.0 and one(spark, tx.seconds(F.col("t")), t="x") == 0.0
    assert one(spark, tx.tolerant_id(F.col("t")), t=" 1746.0 ") == 1746
    assert one(spark, tx.excerpt(F.col("t")), t="\n".join(f"l{i}" for i in range(10))) == "l0 / l1 / l2 / l3 / l4 / l5 / … / l8 / l9"
    assert one(spark, tx.script(F.col("t")), t="मा a") == "mixed"


def test_fuzzy():
    assert fuzzy.indel("kitten", "sitting") == pytest.approx(61.538, abs=1e-3) and fuzzy.indel("", "") == 100.0
    assert fuzzy.token_set("a b c", "c b a d") == 100.0 and fuzzy.token_set("", "x") == 0.0


def test_fusion(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, 3.0, 2.0), (1, 3, float("nan"), 4.0)], "q int, i int, d double, l double")
    got = {r.i: r.fused for r in retrieval.fuse(rows, "q", "d", "l").collect()}
    assert got == pytest.approx({1: 0.35 / 3, 2: 0.35 + 0.325, 3: 0.65})
    with pytest.raises(ValueError):
        retrieval.fuse(rows, "q", "d", "l", 1.5)


def test_queue(spark):
    q = spark.createDataFrame([(i, "new", None, None, i % 4) for i in range(8)], "id long, status string, owner string, expires timestamp_ntz, attempts long")
    now = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    got = queues.claim(q, "me", 3, now)
    assert sorted(r.id for r in got.where("status = 'claimed'").collect()) == [0, 1, 2]
    assert queues.reset_orphans(got, now + F.expr("INTERVAL 1 HOUR")).where("status = 'claimed'").count() == 0
    assert queues.sweep(q).where("status = 'dead'").count() == 2


def test_assets():
    made, calls = [], []

    def fail():
        calls.append(1)
        raise RuntimeError

    got = assets.run([assets.Asset("c", ["b"], lambda: made.append("c")), assets.Asset("a", [], lambda: made.append("a")), assets.Asset("b", ["a"], fail, retries=1), assets.Asset("d", ["a"], lambda: made.append("d"), exists=lambda: True)])
    assert got == {"a": "ok", "b": "failed", "c": "blocked", "d": "skipped"} and made == ["a"] and len(calls) == 2
    with pytest.raises(ValueError):
        assets.topological({"a": ["b"], "b": ["a"]})
    assert assets.descendants({"a": [], "b": ["a"], "c": ["b"], "d": []}, {"a"}) == {"a", "b", "c"}


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿Id,Text\n0012,"a\nb"\nx,"c"\n', encoding="utf-8")
    rows = files.read_csv(spark, f"{tmp_path}/x.csv", {"id": "long", "text": "string", "gone": "string"}).collect()
    assert [(r.id, r.text, r.gone) for r in rows] == [(12, "a\nb", None), (None, "c", None)]
    (tmp_path / "p.txt").write_text("a,b,c\nnone\n")
    assert [(r.left, r.right) for r in files.read_pairs(spark, f"{tmp_path}/p.txt").collect()] == [("a", "b,c")]
    v = files.Versions(spark, f"{tmp_path}/v")
    for name in ("1", "2", "3", "4"):
        v.publish({"t": spark.range(int(name))}, name)
    assert v.versions() == ["2", "3", "4"] and v.current() == "4" and v.read("t").count() == 4
    v.rollback("2")
    assert v.read("t").count() == 2
    with pytest.raises(ValueError):
        v.publish({"t": spark.range(1)}, "2")


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    events.limit(20).write.mode("append").parquet(f"{tmp_path}/in")
    source = stream.read(spark, f"{tmp_path}/in", events.schema)
    q = stream.window_counts(stream.deduplicated(source, "60 days")).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    from textforge.operators import events as e

    batch = stream.window_counts(e.timed(events))
    got = spark.table("counts")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0
    w = stream.write_split(stream.split_refused(stream.read(spark, f"{tmp_path}/in", events.schema), ["view"], "2024-02-01 00:00:00"), f"{tmp_path}/ok", f"{tmp_path}/no", f"{tmp_path}/c2")
    w.awaitTermination()
    n = spark.read.parquet(f"{tmp_path}/ok").count()
    assert n == spark.read.parquet(f"{tmp_path}/in").where("event_type = 'view'").count() and n + spark.read.parquet(f"{tmp_path}/no").count() == events.count() + 20


def plain(v):
    if pd.isna(v):
        return "NULL"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return format(v, ".9g")
    return str(v)


@pytest.mark.skipif(not HAVE, reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in registry.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = [sorted(tuple(plain(v) for v in r) for r in x[sorted(x.columns)].itertuples(index=False)) for x in (a, b)]
    assert rows[0] == rows[1]
