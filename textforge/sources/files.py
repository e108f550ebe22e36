"""Sources and sinks of files: typed CSV, JSON lines, pairs, listings, versioned tables."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """A CSV file with header and line breaks in quotes: every column is read as text and then cast, bad values to null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in rows.columns}
    return rows.select(*[F.col(f"`{names[c.lower()]}`").try_cast(t).alias(c) if c.lower() in names else F.lit(None).cast(t).alias(c) for c, t in schema.items()])


def pick(rows: DataFrame, aliases: list[str]) -> Column:
    """The first of several columns, by name in any case, that isn't blank."""
    names = {c.lower(): c for c in rows.columns}
    found = [F.nullif(F.trim(F.col(f"`{names[a.lower()]}`")), F.lit("")) for a in aliases if a.lower() in names]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(left, right) of lines split at their first comma; lines without one are skipped."""
    parts = F.split("value", ",", 2)
    return spark.read.text(path).where(F.size(parts) == 2).select(F.trim(F.get(parts, F.lit(0))).alias("left"), F.trim(F.get(parts, F.lit(1))).alias("right"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, modified) of files below a folder, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_text_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with every column as text, without the byte order mark; missing cells are empty."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("\ufeff").strip()) for c in rows.columns])


def value_counts(rows: DataFrame, column: str, keep: Column, top: int = 25) -> DataFrame:
    """The most frequent values, trimmed and in lower case, of the rows that ``keep`` holds for: splits of a large file are its chunks."""
    counts = rows.where(keep).groupBy(F.lower(F.trim(column)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(top)


def read_json_document(spark: SparkSession, path: str, schema: str, items: str | None = None) -> DataFrame:
    """A JSON document, an object or a list of them; ``items`` names a list inside that becomes rows."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.explode(items).alias("item")).select("item.*") if items else rows


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, row, values) of .npy files and of the arrays in .npz archives: one row for each first index."""
    schema = "path string, name string, row long, values array<double>"

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                for name, array in found.items() if hasattr(found, "files") else [("", found)]:
                    if array.dtype.kind not in "fiub":
                        array = np.array([[float(i)] for i in range(len(np.atleast_1d(array)))])
                    flat = np.atleast_1d(array).reshape(len(np.atleast_1d(array)), -1).astype(float)
                    for lo in range(0, len(flat), 4096):
                        part = flat[lo : lo + 4096]
                        yield pd.DataFrame({"path": where, "name": name, "row": range(lo, lo + len(part)), "values": part.tolist()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """Rows of a query on a SQLite file that Spark can read: the file is one task's, its rows are streamed in batches."""

    def run(batches):
        import os
        import sqlite3
        import tempfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with tempfile.TemporaryDirectory() as folder:
                    name = os.path.join(folder, "x.db")
                    with open(name, "wb") as f:
                        f.write(content)
                    with sqlite3.connect(name) as db:
                        yield from pd.read_sql_query(sql, db, chunksize=10_000)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def locations(text: Column) -> Column:
    """Addresses in a site map or a listing, once each, sorted."""
    loc, href = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ("<loc>\\s*([^<\\s]+)\\s*</loc>", "href=[\"']([^\"'#]+)"))
    return F.array_sort(F.array_distinct(F.concat(loc, href)))


def import_corpora(known: DataFrame, sources: list[tuple[DataFrame, str, str]], digest: Column, script: Column, least: int = 120) -> DataFrame:
    """Rows (key, lyrics) of several corpora, tagged with source and stage, that are new: long enough, of a known script, of an
    unseen digest, in the order of the list.  ``known`` has the columns key and sha; a known key without a text takes one."""
    parts = [df.select("key", "lyrics", F.lit(source).alias("source"), F.lit(stage).alias("stage"), F.lit(i).alias("place")) for i, (df, source, stage) in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where(F.length(F.coalesce("lyrics", F.lit(""))) >= least).withColumn("sha", digest).withColumn("script", script).where("script <> 'unknown'")
    first = F.row_number().over(Window.partitionBy("sha").orderBy("place", "key"))
    rows = rows.withColumn("first", first).where("first = 1").join(known.where("sha IS NOT NULL").select("sha"), "sha", "left_anti")
    full = known.where("sha IS NOT NULL").select("key", F.lit(True).alias("has"))
    return rows.join(full, "key", "left").where("has IS NULL").drop("first", "has", "place")


def write_one_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header that readers see whole or not at all: it's written aside, then renamed."""
    fs = _Files(rows.sparkSession)
    aside = f"{path}.aside-{uuid.uuid4().hex}"
    rows.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(aside)
    (part,) = [p for p in fs.names(aside) if p.startswith("part-")]
    fs.replace(f"{aside}/{part}", path)
    fs.delete(aside)


def write_array(rows: DataFrame, order: str, vector: str, path: str, dtype: str = "float32") -> int:
    """A .npy file of vectors in order, for readers that need one; rows come to the driver a partition at a time.  Returns their number."""
    import io

    import numpy as np

    fs = _Files(rows.sparkSession)
    parts = [np.asarray(r[0], dtype=dtype) for r in rows.orderBy(order).select(vector).toLocalIterator()]
    out = io.BytesIO()
    np.save(out, np.stack(parts) if parts else np.zeros((0, 0), dtype))
    aside = f"{path}.aside-{uuid.uuid4().hex}"
    fs.put(aside, out.getvalue())
    fs.replace(aside, path)
    return len(parts)


def digest_of(rows: DataFrame) -> str:
    """A digest of a table's rows as a multiset, whatever their order and partitions."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    one = rows.select(F.xxhash64(text).cast("decimal(38,0)").alias("a"), F.xxhash64(text, F.lit(1)).cast("decimal(38,0)").alias("b"))
    row = one.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def snapshot(rows: DataFrame, root: str, stamp: str, keep: int = 5) -> str:
    """Write a snapshot named by its time with its digest beside it, drop all but the newest ``keep``, return the digest."""
    fs = _Files(rows.sparkSession)
    rows.write.parquet(f"{root}/{stamp}")
    digest = digest_of(rows.sparkSession.read.parquet(f"{root}/{stamp}"))
    fs.put(f"{root}/{stamp}.sha256", f"{digest}\n".encode())
    stamps = sorted(n for n in fs.names(root) if not n.endswith(".sha256"))
    for old in stamps[:-keep]:
        fs.delete(f"{root}/{old}")
        fs.delete(f"{root}/{old}.sha256")
    return digest


class _Files:
    """Files of any store that Spark can write to."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def of(self, p: str):
        return self.path(p).getFileSystem(self.conf)

    def exists(self, p: str) -> bool:
        return self.of(p).exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.of(p).listStatus(self.path(p)) if not s.getPath().getName().startswith(".")) if self.exists(p) else []

    def put(self, p: str, data: bytes) -> None:
        out = self.of(p).create(self.path(p))
        out.write(bytearray(data))
        out.close()

    def get(self, p: str) -> str:
        stream = self.of(p).open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, p: str, to: str) -> None:
        """Rename over what is there, in one step."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(to).toUri() if "://" in to else self.path(f"file://{to}").toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self.path(p), self.path(to), options)

    def delete(self, p: str) -> None:
        self.of(p).delete(self.path(p), True)


class Versions:
    """Immutable versions of tables in a folder, with a pointer to the current one that is replaced by one rename.

    A version's manifest has its number (versions are ordered by it, not by name), and rows and digest of each table, which
    are read again from what was written before the pointer moves.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.fs = spark, root.rstrip("/"), _Files(spark)

    def manifest(self, version: str) -> dict:
        return json.loads(self.fs.get(f"{self.root}/versions/{version}/manifest.json"))

    def current(self) -> str | None:
        p = f"{self.root}/current.json"
        return json.loads(self.fs.get(p))["version"] if self.fs.exists(p) else None

    def versions(self) -> list[str]:
        """From the oldest to the newest."""
        return sorted(self.fs.names(f"{self.root}/versions"), key=lambda v: self.manifest(v)["number"])

    def previous(self) -> str | None:
        """The newest version that isn't the current one."""
        return next((v for v in reversed(self.versions()) if v != self.current()), None)

    def publish(self, tables: dict[str, DataFrame], version: str, keep: int = 3) -> None:
        """Write all tables aside, read them again, move them into place, point to them, and drop all but the newest ``keep``."""
        target = f"{self.root}/versions/{version}"
        if self.fs.exists(target):
            raise ValueError(f"version {version} exists")
        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        facts = {}
        for name, df in tables.items():
            df.write.parquet(f"{aside}/{name}")
            written = self.spark.read.parquet(f"{aside}/{name}")
            facts[name] = {"rows": written.count(), "sha256": digest_of(written)}
        known = self.versions()
        number = self.manifest(known[-1])["number"] + 1 if known else 1
        self.fs.put(f"{aside}/manifest.json", json.dumps({"version": version, "number": number, "tables": facts}).encode())
        self.fs.of(self.root).mkdirs(self.fs.path(f"{self.root}/versions"))
        self.fs.of(target).rename(self.fs.path(aside), self.fs.path(target))
        self.verify(version)
        self._point(version)
        for old in self.versions()[:-keep]:
            if old != version:
                self.fs.delete(f"{self.root}/versions/{old}")

    def verify(self, version: str) -> None:
        """Raise ValueError unless the tables are those of the manifest."""
        for name, facts in self.manifest(version)["tables"].items():
            if digest_of(self.read(name, version)) != facts["sha256"]:
                raise ValueError(f"{version}/{name} differs from its manifest")

    def rollback(self, version: str | None = None, verify: bool = False) -> None:
        """Point to another version, the previous one by default."""
        version = version or self.previous()
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        if verify:
            self.verify(version)
        self._point(version)

    def _point(self, version: str) -> None:
        new = f"{self.root}/current-{uuid.uuid4().hex}.json"
        self.fs.put(new, json.dumps({"version": version}).encode())
        self.fs.replace(new, f"{self.root}/current.json")

    def read(self, name: str, version: str | None = None, staging: str | None = None) -> DataFrame:
        """A table of a version, the current one by default; of the folder ``staging`` where nothing is published."""
        version = version or self.current()
        return self.spark.read.parquet(f"{self.root}/versions/{version}/{name}" if version else f"{staging}/{name}")


def contract_schema(fields: dict[str, str]) -> T.StructType:
    """A schema from names and the kinds int, float, bool and str."""
    kinds = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()])
