"""Byte-level BPE by a segment tree over byte positions.

Each piece of text (one match of the tokenizer's pattern) is a row of byte positions.  Leaf i of the piece's tree holds
``rank(i, next live position) * width + i``, or INF when the pair has no rank or position i was merged away.  The root
is then the lowest rank at its leftmost position.  A merge gives the left position the merged token, unlinks the right
one and updates three leaves (left neighbour, the pair itself, the position merged away), each in log(width) steps.

Short pieces are merged many at a time: their trees are the rows of one numpy array and every round does one merge in
each row that still has a ranked pair.  Pieces beyond WIDE bytes get a tree of their own in plain lists; the rules are
the same.

Results of words are kept between documents in a bounded memo, which is emptied when full.  Null texts are empty texts and
have no ids; very long ones are whole.  Of pairs of equal rank the leftmost merges first, and rows that repeat have one result each.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

WIDE = 256
MEMO = 400_000
INF = np.int64(2**62)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class SegmentTreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.merged = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], 0)
        self.words = WordMemo(self._learn)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; INF where there is none.  A token of -1 stands for the end."""
        key = left << 32 | np.maximum(right, 0)
        at = np.searchsorted(self.keys, key)
        return np.where((right >= 0) & (self.keys[at] == key), self.merged[at], INF)

    # -- one tree for each row -------------------------------------------------
    def _rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        n_rows, bits = len(pieces), width.bit_length() - 1
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n_rows, width)
        cols = np.arange(width, dtype=np.int64)
        token = np.full((n_rows, width + 1), -1, dtype=np.int64)
        token[:, :width] = np.where(cols < size[:, None], self.of_byte[raw], -1)
        after = np.minimum(np.broadcast_to(cols + 1, (n_rows, width)), width).copy()
        before = np.broadcast_to(cols - 1, (n_rows, width)).copy()
        tree = np.full((n_rows, 2 * width), INF, dtype=np.int64)
        first = self.rank(token[:, :-1], token[:, 1:])
        tree[:, width:] = np.where(first < INF, first * width + cols, INF)
        for level in range(bits - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] < INF)
        while len(live):
            root = tree[live, 1]
            at, rank = root & (width - 1), root >> bits
            gone = after[live, at]
            far = after[live, gone]
            token[live, at] = rank
            token[live, gone] = -2
            after[live, at] = far
            inner = far < width
            before[live[inner], far[inner]] = at[inner]
            value = self.rank(rank, token[live, far])
            self._update(tree, live, width + at, np.where(value < INF, value * width + at, INF))
            self._update(tree, live, width + gone, np.full(len(live), INF))
            left = before[live, at]
            has = left >= 0
            rows, left, new = live[has], left[has], rank[has]
            value = self.rank(token[rows, left], new)
            self._update(tree, rows, width + left, np.where(value < INF, value * width + left, INF))
            live = live[tree[live, 1] < INF]
        return [row[row >= 0].astype("<u4").tobytes() for row in token[:, :width]]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray) -> None:
        tree[rows, node] = value
        node = node >> 1
        while len(node) and node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    # -- a long piece ----------------------------------------------------------
    def _long(self, piece: bytes) -> bytes:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        token = [int(self.of_byte[b]) for b in piece] + [-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, get = 2**62, self.pairs.get
        tree = [none] * (2 * width)

        def key(i: int) -> int:
            right = token[after[i]]
            rank = get(token[i] << 32 | right) if right >= 0 else None
            return none if rank is None else rank * width + i

        def update(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        for i in range(n):
            tree[width + i] = key(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            far = after[gone]
            token[at], token[gone], after[at] = rank, -2, far
            if far < n:
                before[far] = at
            update(gone, none)
            update(at, key(at))
            if before[at] >= 0:
                update(before[at], key(before[at]))
        return np.array([t for t in token[:n] if t >= 0], dtype="<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces as little-endian unsigned 32-bit integers.  A piece that is itself a token is that token."""
        out: list[bytes | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif not piece:
                out[i] = b""
            elif len(piece) > WIDE:
                out[i] = self._long(piece)
            else:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            step = max(1, 2**19 // width)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                for i, ids in zip(part, self._rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _learn(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each distinct match of the pattern merged once."""
        split = [self.pattern.findall(t) for t in texts]
        new = list({p for ps in split for p in ps})
        ids = dict(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        return [b"".join(map(ids.__getitem__, ps)) for ps in split]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian unsigned 32-bit."""
        return self.words.encode_batch(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class WordMemo:
    """Encode texts word by word, each distinct word once.

    No match of a byte-level pattern spans a space that stands before a character that isn't white space, so a text is
    cut there.  heads keep the ids of parts at a text's start, tails those of parts after a space.  Texts with other
    spaces have a part that is empty or begins with white space; such parts are never kept, and these texts are encoded
    whole.  ``learn`` encodes a list of texts.
    """

    def __init__(self, learn, most: int = MEMO, most_chars: int = 40 * MEMO):
        self.learn, self.most, self.most_chars, self.chars = learn, most, most_chars, 0
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.heads) + len(self.tails) > self.most or self.chars > self.most_chars:
            self.heads, self.tails, self.chars = {}, {}, 0
        heads, tails = self.heads, self.tails
        cut = [t.split(" ") for t in texts]
        first = [c.pop(0) for c in cut]
        new_heads = list(set(first) - heads.keys())
        new_tails = [p for p in set().union(*cut) - tails.keys() if p and not p[0].isspace()]
        ids = self.learn(new_heads + [" " + p for p in new_tails])
        heads.update(zip(new_heads, ids, strict=False))
        tails.update(zip(new_tails, ids[len(new_heads) :], strict=True))
        self.chars += sum(map(len, new_heads)) + sum(map(len, new_tails))
        get, out, whole = tails.__getitem__, [], []
        for i, (head, rest) in enumerate(zip(first, cut, strict=True)):
            try:
                out.append(heads[head] + b"".join(map(get, rest)))
            except KeyError:
                out.append(b"")
                whole.append(i)
        for i, x in zip(whole, self.learn([texts[i] for i in whole]), strict=True):
            out[i] = x
        return out


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> SegmentTreeBPE:
    """One coder for each Python worker."""
    return SegmentTreeBPE(read_ranks(path), pattern)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """(first row, texts) of a batch in slices of about ``most`` characters; null is empty."""
    values = batch.column(column)
    lo, size, texts = 0, 0, []
    for i in range(len(values)):
        text = values[i].as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= most:
            yield lo, texts
            lo, size, texts = i + 1, 0, []
    if texts:
        yield lo, texts


def encode_documents(df, path: str, pattern: str, keep: list[str], text: str = "text"):
    """Add ``token_ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded_sha256`` to columns ``keep``.

    One map over the rows: no shuffle, nothing collected; ids are decoded again for the digest.  Output names that
    clash with a kept column replace it.  An empty table gives an empty table.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    keep = [c for c in keep if c not in ("token_ids", "n_tokens", "decoded_sha256")]
    rows = df.select(*keep, F.col(text).cast("string").alias("__tf_text"))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            kept = batch.select(keep) if keep else None
            for lo, texts in slices(batch, "__tf_text"):
                ids = bpe.encode_batch(texts)
                columns = [kept.column(i).slice(lo, len(texts)) for i in range(len(keep))]
                digests = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digests, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
