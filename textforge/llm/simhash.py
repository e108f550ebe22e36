"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

A fingerprint bit is set if more than half of the text's word shingles have it set in their XXH64 (seed 42).  Two
fingerprints that differ in at most 2 bits are both within 1 bit of some value; so each distinct fingerprint
emits itself and its 64 one-bit variants, and fingerprints that meet at a variant differ in at most 2 bits.  At most 65
fingerprints meet at one variant; there each is linked with the smallest, which keeps the groups whole without all pairs.
Links are made between distinct fingerprints, whatever the number of documents that share one, and verified by a bit count.

Null and empty texts, and texts of white space, have the fingerprint 0; texts are whole whatever their length; a bit set in exactly half of the
shingles is 0.  Rows that repeat have one fingerprint and one group.  Null doc_ids count as larger than all others: a group of nothing
else has a null component_id.  Columns but doc_id and text, whatever their names, are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .components import components
from .store import keep

RADIUS = 2
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str, k: int) -> list[str]:
    """Shingles of k words of a text with A-Z in lower case; a shorter text is one shingle, an empty one none."""
    words = WORD.findall(text if text.islower() else text.translate(LOWER))
    if len(words) <= k:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def shingle_hashes(text: str, k: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)), dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        bits += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit) of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for lo, texts in slices(batch, "__tf_text"):
                fps = [simhash(shingle_hashes(t, k)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("__tf_text")).mapInArrow(run, schema)


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fps.fp`` within RADIUS bits; groups, not all pairs."""
    flips = [0] + [1 << i for i in range(63)] + [-(2**63)]
    flip = F.explode(F.array(*[F.lit(x).cast("long") for x in flips]))
    variants = fps.select("fp", flip.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    least = F.first("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = variants.withColumn("a", least).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def ball_buckets(fps: DataFrame) -> DataFrame:
    """(variant, fp) where two or more, at most 65, of the distinct fingerprints ``fps.fp`` meet: all pairs of RADIUS bits share one."""
    flips = [0] + [1 << i for i in range(63)] + [-(2**63)]
    variants = fps.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    return variants.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("variant"))).where("n > 1").select("variant", "fp")


def groups(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach from it."""
    rows, _ = keep(fingerprints(docs, k), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    nodes, _ = components(ball_links(distinct))
    linked = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc")
    roots = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    labels = linked.join(roots, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")
