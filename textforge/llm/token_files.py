"""Token-ID files: ids of all documents, Huffman-coded in blocks, in ascending doc_id order.

1. Documents are range-partitioned and sorted by doc_id and encoded; a row of the intermediate table is a block of whole
   documents' plain ids.
2. Global counts of ids: each task's last block carries the task's histogram; they are summed by id (at most one row for
   each id and task is shuffled).
3. Blocks are coded with the canonical code made from those counts (the code's lengths are 50 KB, whatever the input).
4. Readers decode each block on its own.  A document's start is its block's start plus what precedes it in the block;
   the starts of blocks come from the blocks' token counts: a running sum within each part, and one over the parts.

The file format is a binary column of a Parquet table, so it works on any store that Spark writes to.  Null and empty texts
have the end id only; very long ones are a block of their own.  Rows of one doc_id are in an order of their texts' hashes, equal
rows side by side; a null doc_id comes first and is stored as the lowest 64-bit integer.  An empty table gives no block
and no row.  Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman
from .bpe import slices
from .store import drop, keep, tasks

BLOCK_TOKENS = 262_144
MEMO, COST = 24_000_000, 64
ENDS = 10_000
LEARN = 20_000  # parts a call of the library
SLICE = 1 << 21  # characters a slice of texts
#: Letters of any version of Unicode, then punctuation; the apostrophe may begin a contraction.
ENDED = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]+)")
NO_ID = -(2**63)


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct part of texts between single spaces (bounded memo).

    The byte-level pattern never joins what a space begins to what precedes it, so parts can be encoded in any company.
    Nor does it join plain letters to punctuation behind them: of a part like ``word,`` the library sees the two ends only
    once each.  Texts with a part that is empty or begins with white space, and texts that hold one of the tokenizer's
    added tokens (``<|endoftext|>`` and the like), go to the library whole.

    The memo has two halves of at most MEMO characters each, COST counted for each entry: when the younger is full it
    becomes the older one, whose entries are forgotten unless they are met again.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # each part is new to the library
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True  # the byte-level form of a space
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.chars = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, entries: dict[str, bytes]) -> None:
        self.chars += sum(map(len, entries)) + COST * len(entries)
        self.young.update(entries)

    def _learn(self, parts: list[str]) -> None:
        """Entries for new parts, many by one call: each part's first id, and no other, begins with a space."""
        for lo in range(0, len(parts), LEARN):
            some = parts[lo : lo + LEARN]
            raw = self._ids([" " + " ".join(some)])[0]
            starts = np.flatnonzero(self.spaced[np.frombuffer(raw, "<u4")])
            if len(starts) != len(some):
                raise ValueError("the vocabulary doesn't cut before spaces")
            at = (4 * starts).tolist() + [len(raw)]
            self._keep(dict(zip(some, map(raw.__getitem__, map(slice, at, at[1:])), strict=True)))

    def _end(self, end: str) -> bytes:
        if end not in self.ends:
            if len(self.ends) > ENDS:
                self.ends = {}
            self.ends[end] = self._ids([end])[0]
        return self.ends[end]

    def _know(self, parts: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of distinct parts, each with a space before it, and which ones can't be encoded alone."""
        if self.chars > MEMO:
            self.old, self.young, self.chars = self.young, {}, 0
        found = list(map(self.young.get, parts))
        missing = [i for i, x in enumerate(found) if x is None]
        again, composed, new, alone = {}, [], {}, []
        for i in missing:
            part = parts[i]
            x = self.old.get(part)
            if x is not None:
                again[part] = found[i] = x
                continue
            m = ENDED.fullmatch(part)
            if m:
                composed.append((i, m[1], m[2]))
                part = m[1]
                if part not in self.young and part not in new:
                    x = self.old.get(part)
                    if x is not None:
                        again[part] = x
                    else:
                        new[part] = -1
            elif part and not part[0].isspace():
                new[part] = i
            else:
                found[i] = b""
                alone.append(i)
        self._keep(again)
        self._learn(list(new))
        for part, i in new.items():
            if i >= 0:
                found[i] = self.young[part]
        whole = {}
        for i, letters, end in composed:
            whole[parts[i]] = found[i] = self.young[letters] + self._end(end)
        self._keep(whole)
        return found, alone

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        index, parts = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, lone = self._know(parts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        alone = np.zeros(len(parts), dtype=bool)
        alone[lone] = True
        # Gather the ids of all words; heads, which have no space before them, come from the library.
        starts = np.cumsum(size) - size
        per = size[index]
        per[first[:-1]] = 0
        ends = np.cumsum(per)
        flat = np.frombuffer(b"".join(ids), "<u4")
        every = flat[np.repeat(starts[index] - (ends - per), per) + np.arange(int(ends[-1]))].tobytes()
        bad = alone[index]
        bad[first[:-1]] = False
        bad = np.cumsum(np.append(0, bad))
        bad = (bad[first[1:]] > bad[first[:-1]]).tolist()
        whole = [b or any(a in t for a in self.added) for t, b in zip(texts, bad, strict=True)]
        heads = self._ids([t if w else t.partition(" ")[0] for t, w in zip(texts, whole, strict=True)])
        cut = (4 * np.append(0, ends)[first]).tolist()
        return [h if w else h + every[a:b] for h, w, a, b in zip(heads, whole, cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _plain_blocks(df: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    rows = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows of one doc_id, null above all, spread over tasks by their texts' hashes.
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(tasks(df.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        encoder, end = library(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        ids: list[int] = []
        sizes: list[int] = []
        parts: list[bytes] = []
        total = 0
        counts = np.zeros(vocabulary, dtype="<i8")

        def out(last: bool = False):
            wide = np.frombuffer(b"".join(parts), "<u4")
            if int(wide.max(initial=0)) >= vocabulary:
                raise ValueError(f"an id of {vocabulary} or more")
            tokens = wide.astype("<u2")
            counts[:] += np.bincount(tokens, minlength=vocabulary)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([block], pa.int64()),
                    pa.array([total], pa.int64()),
                    pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                    pa.array([np.array(sizes, "<u8").tobytes()], pa.binary()),
                    pa.array([tokens.tobytes()], pa.binary()),
                    pa.array([counts.tobytes() if last else None], pa.binary()),
                ],
                names=["part", "block", "n_tokens", "doc_ids", "sizes", "tokens", "counts"],
            )

        for batch in batches:
            doc_ids = batch.column(0)
            for lo, texts in slices(batch, "text", SLICE):
                for i, x in enumerate(encoder.encode_batch(texts)):
                    parts += (x, end)
                    ids.append(doc_ids[lo + i].as_py())
                    sizes.append(len(x) // 4 + 1)
                    total += sizes[-1]
                    if total >= BLOCK_TOKENS:
                        yield out()
                        ids, sizes, parts, total, block = [], [], [], 0, block + 1
        if ids or block:
            yield out(last=True)

    return rows.mapInArrow(run, "part long, block long, n_tokens long, doc_ids binary, sizes binary, tokens binary, counts binary")


def _rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in batch.columns]


def _counts(blocks: DataFrame, vocabulary: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for (counts,) in _rows(batch):
                total += np.frombuffer(counts, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = blocks.select("counts").where("counts IS NOT NULL").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def write_token_files(df: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 65_536) -> tuple[DataFrame, np.ndarray, str]:
    """Write documents' ids; returns the table of blocks (part, block, n_tokens, data), code lengths and its path.

    Ids are below ``vocabulary``, at most 65,536: others raise an error.
    """
    if not end_id < vocabulary <= 1 << 16:
        raise ValueError("ids of this format have 16 bits")
    spark = df.sparkSession
    plain, plain_path = keep(_plain_blocks(df, tokenizer, end_id, vocabulary), "plain-ids")
    lengths = huffman.code_lengths(_counts(plain, vocabulary))
    codes = huffman.canonical(lengths)
    shared = spark.sparkContext.broadcast((codes, lengths))

    def run(batches):
        codes, lengths = shared.value
        for batch in batches:
            for part, block, n, doc_ids, sizes, tokens in _rows(batch):
                data = huffman.write_block(np.frombuffer(doc_ids, "<i8"), np.frombuffer(sizes, "<u8"), np.frombuffer(tokens, "<u2"), codes, lengths)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["part", "block", "n_tokens", "data"])

    files = plain.drop("counts").mapInArrow(run, "part long, block long, n_tokens long, data binary")
    path = plain_path + "-files"
    files.write.option("compression", "uncompressed").parquet(path)
    drop(spark, plain_path)
    return spark.read.schema(files.schema).parquet(path), lengths, path


def read_token_files(files: DataFrame, lengths: np.ndarray, with_ids: bool = True) -> DataFrame:
    """Decode blocks: doc_id, start, n_tokens, ids_crc32 and, if asked for, token_ids (binary, little-endian unsigned 32-bit)."""
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(lengths)
    sizes = files.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = sizes.select("part", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner")).join(
        F.broadcast(parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("outer"))), "part"
    )
    starts = starts.select("part", "block", (F.col("inner") + F.col("outer")).alias("base"))

    def run(batches):
        table = _table(shared.value.tobytes())
        for batch in batches:
            for part, block, data in _rows(batch):
                doc_ids, n, tokens = huffman.read_block(data, table)
                raw, ends = tokens.astype("<u4").tobytes(), np.cumsum(n)
                cut = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                size = len(cut)
                columns = [
                    pa.array([part] * size, pa.int64()),
                    pa.array([block] * size, pa.int64()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(ends - n, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(cut, pa.binary())] * with_ids, names=names)

    names = ["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32"] + ["token_ids"] * with_ids
    schema = "part long, block long, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", token_ids binary" * with_ids
    rows = files.select("part", "block", "data").mapInArrow(run, schema)
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return rows.join(starts, ["part", "block"]).select(doc_id, (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["token_ids"] * with_ids)


@lru_cache(maxsize=2)
def _table(lengths: bytes):
    return huffman.decode_table(np.frombuffer(lengths, dtype=np.uint8))
