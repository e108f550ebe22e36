"""Canonical length-limited Huffman codes of token ids, in independent blocks.

Code lengths come from global counts by package-merge and are at most LIMIT bits.  A block holds whole documents.  It
stores its documents' ids and sizes, the packed codes and, every STEP tokens, the bit offset at which decoding can
start.  Decoding looks LIMIT bits up in one table and runs all checkpoints of a block side by side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LIMIT = 18
STEP = 128
MAGIC = b"TFH1"
HEADER = struct.Struct("<4sQQQI")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    leaf = np.arange(n)
    # Each level keeps, in order of weight, which entries are leaves; the others are packages of two of the level below.
    levels, value = [], weight
    is_leaf = np.ones(n, dtype=bool)
    levels.append(is_leaf)
    for _ in range(limit - 1):
        m = len(value) // 2
        packed = value[0 : 2 * m : 2] + value[1 : 2 * m : 2]
        both = np.concatenate([weight, packed])
        kind = np.concatenate([np.ones(n, dtype=bool), np.zeros(m, dtype=bool)])
        at = np.argsort(both, kind="stable")
        value, is_leaf = both[at], kind[at]
        levels.append(is_leaf)
    take = 2 * n - 2
    depth = np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth += leaf < leaves
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    per = np.bincount(lengths[order], minlength=LIMIT + 2)
    at = 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        code <<= length - last
        last = length
        k = int(per[length])
        codes[order[at : at + k]] = np.arange(code, code + k, dtype=np.uint64)
        code += k
        at += k
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each word of ``limit`` bits: the id whose code it starts with, and that code's length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = (1 << (limit - lengths[order].astype(np.int64))).astype(np.int64)
    ids = np.zeros(1 << limit, dtype=np.uint32)
    size = np.ones(1 << limit, dtype=np.uint8)
    filled = int(span.sum())
    ids[:filled] = np.repeat(order, span)
    size[:filled] = np.repeat(lengths[order], span)
    return ids, size


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids as bytes, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 3, dtype=np.uint64)
    if len(ids):
        word = starts >> 5
        shifted = codes[ids] << (64 - size - (starts & 31)).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        at = word[first]
        words[at] += np.add.reduceat(shifted >> np.uint64(32), first)
        words[at + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::STEP].astype("<u8")


def unpack(packed: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """``n`` ids from packed codes, one lane for each checkpoint."""
    ids, size = table
    lanes = len(offsets)
    out = np.zeros((STEP, lanes), dtype=np.uint32)
    raw = np.frombuffer(packed + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at = offsets.astype(np.int64).copy()
    mask, most, shift = np.uint32((1 << limit) - 1), len(window) - 1, 32 - limit
    for step in range(min(STEP, n)):
        word = window[np.minimum(at >> 3, most)] >> (shift - (at & 7)).astype(np.uint32) & mask
        out[step] = ids[word]
        at += size[word]
    return out.T.reshape(-1)[:n]


def write_block(doc_ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """One block: header, document ids, sizes, checkpoints, codes; a crc32 of everything stands at the end."""
    packed, offsets = pack(tokens, codes, lengths)
    body = HEADER.pack(MAGIC, len(doc_ids), len(tokens), len(packed), STEP) + doc_ids.astype("<i8").tobytes() + sizes.astype("<u8").tobytes() + offsets.tobytes() + packed
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, sizes, tokens) of a block; raises ValueError when it's damaged."""
    body, crc = block[:-4], struct.unpack("<I", block[-4:])[0]
    if zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    magic, n_docs, n, n_packed, step = HEADER.unpack_from(body)
    if magic != MAGIC or step != STEP:
        raise ValueError("not a block of this format")
    at = HEADER.size
    doc_ids = np.frombuffer(body, "<i8", n_docs, at)
    sizes = np.frombuffer(body, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    lanes = -(-n // STEP)
    offsets = np.frombuffer(body, "<u8", lanes, at)
    return doc_ids, sizes, unpack(body[at + 8 * lanes : at + 8 * lanes + n_packed], offsets, n, table)
