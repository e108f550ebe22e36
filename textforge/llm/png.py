"""Grey 8-bit PNG images of texts, and hashes of their low-frequency cosine terms.

A text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, are the samples of an image 64 wide.  Readers test the
signature, every chunk's CRC and zlib's own checksum, and undo all five row filters.  Null texts are empty: one row of
zeros; texts have no bound of length.  Equal texts, rows that repeat among them, have equal images and hashes; a cosine term equal to the
median counts as below it.  Kept columns with names of the results are replaced; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def payload_of(text: str) -> tuple[bytes, int]:
    """Padded bytes and the number of unpadded ones."""
    raw = text.encode()
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"), len(raw)


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """The image; each uses the one of the filters none, left and up whose rows have the smallest sum of magnitudes."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left, up = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (image, left, up)]
    kind = int(np.argmin(cost))
    rows = np.empty((len(image), WIDTH + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, (image, left, up)[kind]
    data = zlib.compress(rows.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[i : i + IDAT]) for i in range(0, len(data), IDAT)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> np.ndarray:
    """Samples, a row of the image in each row; raises ValueError for damaged or other images."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(png) and not ended:
        (size,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image without interlace")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("damaged pixels") from e
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of pixels")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo row filters; runs of rows with one of the first three kinds are undone at once."""
    out = np.empty_like(rows)
    cuts = [0, *(np.flatnonzero(np.diff(kinds.astype(np.int16))) + 1).tolist(), len(rows)]
    above = np.zeros(rows.shape[1], np.uint8)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo == hi:
            continue
        kind = int(kinds[lo])
        if kind == 0:
            out[lo:hi] = rows[lo:hi]
        elif kind == 1:
            out[lo:hi] = np.cumsum(rows[lo:hi], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[lo:hi] = np.cumsum(rows[lo:hi], axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(lo, hi):
                before = (out[y - 1] if y else above).tolist()
                line, left, corner = rows[y].tolist(), 0, 0
                for x, value in enumerate(line):
                    b = before[x]
                    if kind == 3:
                        guess = (left + b) // 2
                    else:
                        p = left + b - corner
                        da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
                        guess = left if da <= db and da <= dc else b if db <= dc else corner
                    left = line[x] = value + guess & 255
                    corner = b
                out[y] = line
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[hi - 1]
    return out


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(k)[:, None])


SIDE, LOW = 32, 8
BASIS = _cosines(SIDE, LOW)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8x8 lowest cosine terms of the 32x32 reduced image lie above their median."""
    height = len(image)
    grey = image.reshape(height, SIDE, -1).mean(axis=2, dtype=np.float64)
    if height >= SIDE:
        starts = np.arange(SIDE) * height // SIDE
        small = np.add.reduceat(grey, starts, axis=0) / np.diff(np.append(starts, height))[:, None]
    else:
        small = grey[np.arange(SIDE) * height // SIDE]
    terms = (BASIS @ small @ BASIS.T).reshape(-1)
    terms[0] = 0.0
    return np.packbits(terms > np.median(terms)).tobytes()


def add_media(df, keep: list[str], text: str = "text"):
    """Columns ``keep`` with media (PNG), media_hash (8 bytes) and the figures of the payload read back from the PNG."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from .bpe import slices

    added = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "media": T.BinaryType(), "media_hash": T.BinaryType()}
    keep = [c for c in keep if c not in added]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, t) for c, t in added.items()])

    def run(batches):
        for batch in batches:
            for lo, texts in slices(batch, "__tf_text"):
                rows = []
                for text in texts:
                    payload, n = payload_of(text)
                    media = encode_png(payload)
                    image = decode_png(media)
                    back = image.tobytes()
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), media, cosine_hash(image)))
                columns = [batch.column(i).slice(lo, len(texts)) for i in range(len(keep))]
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=schema.fieldNames())

    return df.select(*keep, F.col(text).cast("string").alias("__tf_text")).mapInArrow(run, schema)
