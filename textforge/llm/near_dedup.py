"""Near-duplicate groups of texts: five-word shingles, similarity 0.8 or more.

Candidates come from two sources over distinct texts (equal texts are one, whatever their number):

- SimHash: the meet-in-the-middle balls of simhash.ball_links, which find fingerprints within 2 bits.
- Views: at a similarity of 0.8 most 64-bit fingerprints differ in more than 2 bits (9 on the mean, as measured),
  beyond any ball that can be emitted.  So each text also has VIEWS fingerprints, each a hash of the PICK shingles
  smallest in a permutation; texts as alike as 0.8 share one of them with a probability over 0.999.

Pairs are verified by the Jaccard similarity of their whole shingle sets (as 32-bit hashes), and verified pairs make groups.
In each bucket every text meets the smallest one first.  Where a bucket's texts are of several groups after that, those of
other groups meet the text with most verified links, and then all pairs of different groups that are left are verified,
but those whose set sizes rule the similarity out.  Texts of fewer than five words are one shingle; those without words are one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .components import components
from .simhash import ball_buckets, shingle_hashes, simhash
from .store import drop, keep, release

WORDS = 5
SIMILARITY = 0.8
VIEWS, PICK = 20, 4


def view_fingerprints(hashes: np.ndarray) -> list[int]:
    """A hash of the PICK smallest distinct shingles in each of VIEWS permutations."""
    out = []
    for v in range(VIEWS):
        mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (v + 1) & 2**64 - 1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        least = np.argpartition(mixed, PICK)[:PICK] if len(mixed) > PICK else np.arange(len(mixed))
        chosen = np.sort(hashes[least])
        out.append(int((np.bitwise_xor.reduce(chosen * np.uint64(2 * v + 3) + (chosen >> np.uint64(29)))).astype(np.int64)) if len(chosen) else 0)
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("views", T.ArrayType(T.LongType())), T.StructField("shingles", T.BinaryType()), T.StructField("n", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for lo, texts in slices(batch, "__tf_text"):
                rows = []
                for text in texts:
                    every = shingle_hashes(text, WORDS)
                    hashes = np.unique(every)
                    rows.append((simhash(every), view_fingerprints(hashes), np.unique(hashes.astype("<u4"))))
                fp, views, sets = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(fp, pa.int64()), pa.array(views, pa.list_(pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32())], names=["t", "fp", "views", "shingles", "n"])

    return docs.mapInArrow(run, schema)


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            good = []
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_py(), "<u4"), np.frombuffer(y[i].as_py(), "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= SIMILARITY * (len(p) + len(q) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _members(sketches: DataFrame) -> DataFrame:
    """view, key, t, n of the texts of each bucket of two or more: views, equal fingerprints (view -1), balls (view -2)."""
    rows = sketches.select("t", "fp", "n")
    views = sketches.select(F.posexplode("views").alias("view", "key"), "t", "n").union(rows.select(F.lit(-1), "fp", "t", "n"))
    shared = views.groupBy("view", "key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("view", "key")
    balls = ball_buckets(rows.select("fp").distinct()).join(rows, "fp").select(F.lit(-2).alias("view"), F.col("variant").alias("key"), "t", "n")
    return views.join(shared, ["view", "key"]).select("view", "key", "t", "n").union(balls)


def _groups(sketches: DataFrame) -> DataFrame:
    """(t, root) of each text that verified pairs link to a smaller one."""
    spark = sketches.sparkSession
    sets = sketches.select("t", "shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        distinct = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        both = distinct.join(sets.withColumnsRenamed({"t": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"t": "b", "shingles": "y"}), "b")
        return keep(_verified(both.select("a", "b", "x", "y")), "verified")[0]

    def still_open(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, str]:
        """Members, with their roots, of the buckets whose texts are of several groups."""
        rows = members.select("view", "key", "t", "n").join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))
        several = rows.groupBy("view", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("view", "key")
        return keep(rows.join(several, ["view", "key"]).select("view", "key", "t", "n", "root"), "open")

    def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
        """Roots after further links: components over roots, not over texts."""
        of = lambda c: roots.select(F.col("t").alias(c), F.col("root").alias("r" + c))
        ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        over = components(ends)[0].select(F.col("node"), F.col("root").alias("top"))
        old = roots.join(over, roots["root"] == over["node"], "left").select("t", F.coalesce("top", "root").alias("root"))
        return keep(old.union(over.join(roots.select(F.col("t").alias("node")), "node", "left_anti").select("node", "top")), "roots")[0]

    members, members_path = keep(_members(sketches), "buckets")
    least = members.groupBy("view", "key").agg(F.min("t").alias("a"))
    edges = verify(members.join(least, ["view", "key"]).select("a", F.col("t").alias("b")))
    roots = components(edges)[0].withColumnRenamed("node", "t")
    left, path = still_open(members, roots)
    drop(spark, members_path)
    if left.isEmpty():
        return roots
    # The text with most links is the likely middle of a star, so few groups are left for the pairs of the last step.
    links = edges.select(F.explode(F.array("a", "b")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("links"))
    best = F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.col("t").alias("t"), F.col("root").alias("root"), F.col("n").alias("n"))
    middle = left.join(links, "t", "left").groupBy("view", "key").agg(F.max(best).alias("m"))
    alike = lambda x, y: F.least(x, y) >= SIMILARITY * F.greatest(x, y)
    met = left.join(middle, ["view", "key"]).where((F.col("root") != F.col("m.root")) & alike(F.col("n"), F.col("m.n")))
    roots = merged(roots, verify(met.select(F.col("m.t").alias("a"), F.col("t").alias("b"))))
    left, last_path = still_open(left, roots)
    drop(spark, path)
    other = left.select("view", "key", F.col("t").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    met = left.join(other, ["view", "key"]).where((F.col("t") < F.col("b")) & (F.col("root") != F.col("rb")) & alike(F.col("n"), F.col("nb")))
    roots = merged(roots, verify(met.select(F.col("t").alias("a"), "b")))
    drop(spark, last_path)
    return roots


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds __tf_h and __tf_m, two hashes that tell texts apart; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("__tf_h", F.xxhash64(text)).withColumn("__tf_m", F.md5(text.cast("binary")))


def near_groups(docs: DataFrame) -> DataFrame:
    """__tf_h, __tf_m and component_id (smallest doc_id of the group) of each distinct text."""
    rows = _keyed(docs.select("doc_id", "text"))
    ids = rows.groupBy("__tf_h", "__tf_m").agg(F.min("doc_id").alias("doc"))
    # A text's number is its 64-bit hash; of unequal texts with one hash all but the first get another.
    place = F.row_number().over(Window.partitionBy("__tf_h").orderBy("__tf_m"))
    ids, ids_path = keep(ids.withColumn("t", F.when(place == 1, F.col("__tf_h")).otherwise(F.xxhash64("__tf_h", "__tf_m"))), "texts")
    # One row stands for each distinct text: the one with the group's smallest id.
    alone = rows.join(ids, ["__tf_h", "__tf_m"]).where(F.col("doc_id").eqNullSafe(F.col("doc"))).select("t", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__tf_text")).dropDuplicates(["t"])
    sketches, sketches_path = keep(_sketches(alone), "sketches")
    groups = _groups(sketches)
    drop(docs.sparkSession, sketches_path)
    linked = ids.join(groups, "t", "left").select("__tf_h", "__tf_m", F.coalesce("root", "t").alias("root"), "doc")
    least = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    found, _ = keep(linked.join(least, "root").select("__tf_h", "__tf_m", "component_id"), "near-groups")
    drop(docs.sparkSession, ids_path)
    release(docs.sparkSession)
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of their group (one of several equal rows); null ids in groups of their own.

    Texts are whole whatever their length; an empty table gives no row; columns beside doc_id and text pass through.
    """
    labels = near_groups(docs).withColumnRenamed("component_id", "__tf_c")
    found = _keyed(docs).join(labels, ["__tf_h", "__tf_m"]).where("doc_id = __tf_c OR (doc_id IS NULL AND __tf_c IS NULL)")
    return found.dropDuplicates(["doc_id", "__tf_h", "__tf_m"]).select(*docs.columns)
