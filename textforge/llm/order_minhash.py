"""Order MinHash fingerprints, with DataFrame functions only.

A text's k-mers are runs of K words.  Equal k-mers of a text are numbered by occurrence; (k-mer, number) pairs are hashed,
the hash's upper bits choose one of BINS bins, and the PICK smallest pairs of each bin are put back into text order and
hashed as a tuple.  A tuple survives an edit only if its k-mers and their order do, so likeness falls with edit distance.
The likeness of two fingerprints is the share of bins, used by either, that hold equal tuples; two empty ones are alike.

All of it happens inside a row: two sorts of 64-bit integers, with the hash in the upper 40 bits and the position in the lower
24 (positions wrap beyond 16 million words; nothing else depends on the length).  Null texts are empty.  Texts of
fewer than K words are one k-mer; those without words have an empty fingerprint.  Equal texts have equal fingerprints; rows that
repeat follow one another.  Columns but doc_id and text, whatever their names, are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

K = 3
BINS = 64
PICK = 2
LOW = (1 << 24) - 1
#: Documents for each bucket of neighbouring doc_ids, as long as there are no more than MOST buckets.
BUCKET, MOST = 64, 1 << 14
NO_ID = -(2**63)


def add_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the signature of column ``text``, an array of longs (bin << 48 | 48 hash bits, ascending)."""
    high = -1 - LOW
    q = f"`{text}`"
    # Each step is a column of its own, so that no step is evaluated twice inside a lambda.
    steps = {
        "__w": f"array_remove(split(coalesce({q}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), '')",
        "__k": f"""CASE WHEN size(__w) = 0 THEN CAST(array() AS ARRAY<BIGINT>)
            WHEN size(__w) <= {K} THEN array((xxhash64(__w) & {high}L))
            ELSE sort_array(transform(sequence(0, size(__w) - {K}), i -> (xxhash64({", ".join(f"__w[i + {j}]" for j in range(K))}) & {high}L) | CAST(i & {LOW} AS BIGINT))) END""",
        "__s": f"""CASE WHEN size(__k) = 0 THEN CAST(array() AS ARRAY<INT>)
            ELSE filter(sequence(0, size(__k) - 1), i -> i = 0 OR (__k[i] & {high}L) <> (__k[i - 1] & {high}L)) END""",
        "__e": f"""CASE WHEN size(__k) = 0 THEN __k
            WHEN size(__s) = size(__k) THEN sort_array(transform(__k, x -> (xxhash64(x & {high}L, 0) & {high}L) | (x & {LOW}L)))
            ELSE sort_array(transform(arrays_zip(__k, flatten(transform(__s, (a, j) -> sequence(0, coalesce(get(__s, j + 1), size(__k)) - a - 1)))),
                z -> (xxhash64(z['__k'] & {high}L, z['1']) & {high}L) | (z['__k'] & {LOW}L))) END""",
        "__p": f"filter(__e, (x, i) -> i < {PICK} OR shiftright(x, {64 - BINS.bit_length() + 1}) <> shiftright(__e[i - {PICK}], {64 - BINS.bit_length() + 1}))",
        "__b": f"""CASE WHEN size(__p) = 0 THEN CAST(array() AS ARRAY<INT>)
            ELSE filter(sequence(0, size(__p) - 1), i -> i = 0 OR shiftright(__p[i], {64 - BINS.bit_length() + 1}) <> shiftright(__p[i - 1], {64 - BINS.bit_length() + 1})) END""",
        out: f"""transform(__b, (a, j) -> shiftleft(shiftright(__p[a], {64 - BINS.bit_length() + 1}) + {BINS // 2}L, 48) | shiftrightunsigned(xxhash64(
            transform(sort_array(transform(slice(__p, a + 1, coalesce(get(__b, j + 1), size(__p)) - a), x -> shiftleft(x & {LOW}L, 40) | shiftrightunsigned(x, 24))),
                y -> y & {(1 << 40) - 1}L)), 16))""",
    }
    rows = df
    for name, step in steps.items():
        rows = rows.withColumn(name, F.expr(step))
    return rows.drop(*(n for n in steps if n.startswith("__")))


def likeness(a: str, b: str) -> Column:
    both = f"size(array_union(transform({a}, x -> shiftright(x, 48)), transform({b}, x -> shiftright(x, 48))))"
    return F.expr(f"CASE WHEN {both} = 0 THEN 1D ELSE size(array_intersect({a}, {b})) / CAST({both} AS DOUBLE) END")


def as_string(sig: str) -> Column:
    return F.expr(f"array_join(transform({sig}, x -> lower(lpad(hex(x), 16, '0'))), '')")


def with_bucket(docs: DataFrame) -> DataFrame:
    """v, h, text, bucket of each document; buckets are in order of v (doc_id, null first) and h (the text's hash).

    Split points are quantiles of v, so buckets are about equal whatever the ids.  Where one id takes several split points,
    its rows are dealt out among their buckets by hash.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("v"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    buckets = 1 << min(MOST.bit_length() - 1, max(0, (n // BUCKET).bit_length()))
    splits = rows.agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)] or [0.5], 4 * buckets)).first()[0] or []
    rows = rows.withColumn("h", F.xxhash64("text"))
    array = f"from_json('{sorted(map(int, splits))}', 'array<bigint>')"
    steps = ", ".join(str(1 << k) for k in range(buckets.bit_length() - 1, -1, -1))
    below = lambda op: F.expr(f"aggregate(array({steps}), 0, (at, step) -> IF(get({array}, at + step - 1) {op} v, at + step, at))")
    rows = rows.withColumn("lt", below("<")).withColumn("le", below("<="))
    share = F.floor(F.expr("shiftrightunsigned(h, 11) / 9007199254740992D") * (F.col("le") - F.col("lt")))
    # Never null, so that no filter is pushed below one of two uses of the buckets, which then share a shuffle.
    return rows.withColumn("bucket", F.coalesce(F.col("lt") + share.cast("int"), F.lit(0))).drop("lt", "le")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sig and next_text, next_sig: those of the next document by doc_id; the first's after the last.

    Documents find their next one within their bucket.  The last of a bucket joins the first of the next bucket that has any;
    these first ones, at most MOST, are a table of their own.  Null ids come first, rows of one id by their texts' hashes.
    """
    columns = ["doc_id", "text", "sig", "next_text", "next_sig"]
    placed = with_bucket(docs)
    near = Window.partitionBy("bucket").orderBy("v", "h", "text")
    head = placed.withColumn("place", F.row_number().over(near)).where("place = 1")
    head, _ = keep(add_signature(head.select("bucket", "text"), "text", "sig"), "bucket-heads")
    over = Window.orderBy("bucket")  # one row for each bucket
    order = head.select("bucket", F.coalesce(F.lead("bucket").over(over), F.first("bucket").over(over)).alias("next_bucket"))
    first = head.select(F.col("bucket").alias("next_bucket"), F.col("text").alias("next_text"), F.col("sig").alias("next_sig"))

    rows = add_signature(placed, "text", "sig").withColumn("next_text", F.lead("text").over(near)).withColumn("next_sig", F.lead("sig").over(near))
    last = rows.where("next_text IS NULL").drop("next_text", "next_sig").join(order, "bucket").join(first, "next_bucket")
    return rows.where("next_text IS NOT NULL").select(*columns).union(last.select(*columns))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likenesses."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    edited = "concat(substring(text, 1, CAST(n_chars - n_chars DIV 2 AS INT)), substring(next_text, 1, CAST(n_chars DIV 2 AS INT)))"
    rows = add_signature(rows.withColumn("edited", F.expr(edited)), "edited", "edited_sig")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string("sig").alias("fingerprint"),
        as_string("edited_sig").alias("edited_fingerprint"), likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )
