"""Line dedup: repeated multi-line chunks with content-defined boundaries.

Lines are physical lines, cut further after the end of a sentence, since a passage may sit inside a paragraph.  A rolling hash
over the last two lines' hashes chooses where a chunk ends, with a chance of one in MEAN, and nothing else does; so
boundaries depend on content alone and come back in step after insertions.  Chunks of at least two lines and LEAST words
take part, and of one line if it has LONG words.

So that passages of LONG words are found wherever chunks end, anchors take part too: of the runs of GRAM words in each
window of LONG words the one of the smallest hash, which equal windows choose alike.

1. Hashes of all chunks and anchors are counted; each occurrence of a repeated one but the first (lowest doc_id, then earliest)
   is compared there, byte for byte, and widened on both sides as far as the texts are equal.  A chunk is cut as it is widened,
   an anchor if LONG words are equal.  Only the part of the first document's text up to the next anchors on both
   sides travels to the other; where texts are equal up to an end of it, and that end isn't inside of another span, the
   next step compares them whole.
2. An anchor that isn't cut may still be in a passage that stands elsewhere than in the anchor's first place, if it stands in three
   places or more: it's widened by half of what LONG words need, to either side, and such runs are counted and compared
   in the same way; then those that are left by the other half, in all windows of LONG words.
3. Spans of a document are merged and cut from its text; ``n_chars`` follows.

Only what stands in the text of a lower (doc_id, place) is cut, so one copy of it always stays.  Chunks of one hot
hash are counted by partial aggregation and joined, never collected.  Rows equal in doc_id and text are one document and get
the same result.  Null texts stay null; empty texts, texts of one short line and empty tables pass unchanged; null doc_ids
come last.  Texts are whole whatever their length; a worker needs about 60 bytes for each character of the longest.  Columns
beside doc_id and text pass through, whatever their names but ``removed_chars``, which is replaced.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .store import drop, keep, release

#: Words of a chunk of two lines or more, of a line that is a chunk alone or of a passage, and of an anchor.
LEAST, LONG, GRAM = 12, 50, 16
MEAN = 3
MEET = 64
#: Characters of a first document that are compared together.
ZONE = 8192
#: Characters on both sides of a widened anchor that are compared at first.
NEAR = 512
LAST_ID = 2**63 - 1
SLICE = 1 << 18

SPACE = np.zeros(0x3002, dtype=bool)
SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
STOP = np.zeros(128, dtype=bool)
STOP[[ord(c) for c in ".!?"]] = True
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The first n powers, or more, of BASE and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(n + n // 4, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """The minimum or maximum, ``least``, of each n values in a row."""
    if len(x) < n:
        return x[:0]
    size = 1
    while 2 * size <= n:
        x, size = least(x[:-size], x[size:]), 2 * size
    return least(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


class Runs:
    """Words of texts, one behind the other with a space between, and hashes of runs of them, white space included."""

    def __init__(self, texts: list[str]):
        self.codes = codes = np.frombuffer(" ".join(texts).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.sizes, self.first = sizes, np.cumsum(sizes + 1) - sizes - 1
        inside = np.zeros(len(codes) + 2, dtype=bool)
        np.logical_not(SPACE[np.minimum(codes, 0x3001)], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.first, self.starts, side="right") - 1
        power, self.inverse = _power(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=self.sums[1:])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the runs from words ``first`` to ``last``."""
        a, b = self.starts[first], self.ends[last]
        return _mixed((self.sums[b] - self.sums[a]) * self.inverse[a])

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, not 0, of the runs of GRAM words from each word, and which of them are of one text."""
        first = np.arange(max(0, len(self.starts) - GRAM + 1))
        return self.hashes(first, first + (GRAM - 1)) | np.uint64(1), self.doc[: len(first)] == self.doc[GRAM - 1 :]

    def windows(self) -> np.ndarray:
        """Which runs of LONG words are of one text."""
        return self.doc[: max(0, len(self.doc) - LONG + 1)] == self.doc[LONG - 1 :]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the anchors: runs of GRAM words that are the smallest of some window."""
        grams, whole = self.grams()
        n = LONG - GRAM + 1
        ends = np.zeros(n - 1, dtype=np.uint64)
        least = np.where(self.windows(), _sliding(grams, n, np.minimum), np.uint64(0))
        if not len(least):
            return np.zeros(0, np.int64), grams[:0]
        chosen = (_sliding(np.concatenate([ends, least, ends]), n, np.maximum) == grams) & whole
        # Of neighbours with one hash (a word over and over) the first and the last will do.
        same = np.append(False, grams[1:] == grams[:-1])
        at = np.flatnonzero(chosen & ~(same & np.append(same[1:], False)))
        return at, grams[at]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last words of the lines."""
        if not len(self.starts):
            return self.starts, self.starts
        breaks = np.cumsum(np.append(0, self.codes == 10))
        gap = self.ends[:-1]
        stop = STOP[np.minimum(self.codes[gap - 1], 127)] & (self.codes[gap] == 32)
        ended = stop | (breaks[gap] != breaks[self.starts[1:]]) | (self.doc[1:] != self.doc[:-1])
        last = np.append(np.flatnonzero(ended), len(self.starts) - 1)
        return np.append(0, last[:-1] + 1), last

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last words of the chunks that take part."""
        first, last = self.lines()
        if not len(first):
            return first, last
        h, doc = self.hashes(first, last), self.doc[first]
        before = np.where(np.append(False, doc[1:] == doc[:-1]), np.append(np.uint64(0), h[:-1]), np.uint64(0))
        rolled = _mixed(before * np.uint64(BASE) + h)
        ended = ((rolled >> np.uint64(32)) % np.uint64(MEAN) == 0) | np.append(doc[1:] != doc[:-1], True)
        end = np.flatnonzero(ended)
        begin = np.append(0, end[:-1] + 1)
        words = last[end] - first[begin] + 1
        take = ((end > begin) & (words >= LEAST)) | (words >= LONG)
        return first[begin[take]], last[end[take]]

    def rows(self) -> dict[str, np.ndarray]:
        """doc, a, b, c (hash, odd for chunks), lo, hi (from the anchor before to the one behind) of chunks and anchors."""
        at, grams = self.anchors()
        first, last = self.chunks()
        left, right, of = self.starts[at], self.ends[at + (GRAM - 1)], self.doc[at]
        c = np.append(grams & ~np.uint64(1), _mixed(self.hashes(first, last)) | np.uint64(1))
        a, b, doc = np.append(left, self.starts[first]), np.append(right, self.ends[last]), np.append(of, self.doc[first])
        base, end = self.first[doc], self.first[doc] + self.sizes[doc]
        # Anchors of other texts lie outside of this one's bounds.
        lo = np.maximum(base, np.append(-1, left)[np.searchsorted(left, a, side="left")])
        hi = np.minimum(end, np.append(right, len(self.codes))[np.searchsorted(right, b, side="right")])
        return {"doc": doc, "a": a - base, "b": b - base, "c": c.view(np.int64), "lo": lo - base, "hi": hi - base}

    def around(self, chars: list[int], words: int, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ``words`` + ``more`` words of a single text that hold the run of ``words`` words at each of ``chars``.

        These are the one that begins with it and the one that ends with it, or, if that makes LONG words, all.  Returns which of
        ``chars`` each belongs to, its first word, and its last one.
        """
        at = np.searchsorted(self.starts, chars)
        steps = np.arange(-more, 1) if words + more == LONG else np.array([-more, 0])
        first = (at[:, None] + steps).reshape(-1)
        of = np.repeat(np.arange(len(at)), len(steps))
        inside = (first >= 0) & (first + words + more <= len(self.starts))
        return of[inside], first[inside], first[inside] + words + more - 1


def _keys(docs: DataFrame) -> DataFrame:
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.withColumn("__tf_d", d).withColumn("__tf_h", F.xxhash64(F.col("text").cast("string")))


PLACES = "d long, h long, a int, b int, c long, lo int, hi int"


def _places(docs: DataFrame) -> DataFrame:
    """A row for each chunk and anchor: document, span, hash, and how far texts are compared at first."""

    def run(batches):
        for batch in batches:
            d, h = (batch.column(i).to_numpy() for i in range(2))
            for at, texts in slices(batch, "text", SLICE):
                rows = Runs(texts).rows()
                doc = rows.pop("doc") + at
                columns = [pa.array(d[doc]), pa.array(h[doc]), *(pa.array(v, pa.int64() if k == "c" else pa.int32()) for k, v in rows.items())]
                yield pa.RecordBatch.from_arrays(columns, names=["d", "h", *rows])

    rows = docs.where("text IS NOT NULL").select("__tf_d", "__tf_h", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PLACES)


def _same(equal, most: int) -> int:
    """The largest n up to ``most`` with equal(0, n), where equal(i, j) compares characters i to j: steps double, then halve."""
    n, step = 0, 64
    while n < most and equal(n, min(n + step, most)):
        n, step = min(n + step, most), 2 * step
    end = min(n + step, most)
    while end - n > 1:
        half = (n + end) // 2
        if equal(n, half):
            n = half
        else:
            end = half
    return n


def widened(x: str, a: int, b: int, y: str, at: int) -> tuple[int, int, bool, bool]:
    """The span a, b of x, equal to y from ``at`` on, as far as whole words beside it, and white space before them, are equal too.

    Also whether the texts are equal up to the start, and to the end, of y.
    """
    end = at + b - a
    n = _same(lambda i, j: x[a - j : a - i] == y[at - j : at - i], min(a, at))
    m = _same(lambda i, j: x[b + i : b + j] == y[end + i : end + j], min(len(x) - b, len(y) - end))
    left, right = n == at, m == len(y) - end
    if n < a and not x[a - n - 1].isspace():
        while n and not x[a - n].isspace():
            n -= 1
    if b + m < len(x) and not x[b + m].isspace():
        while m and not x[b + m - 1].isspace():
            m -= 1
    while m and x[b + m - 1].isspace():  # what stands behind the span keeps its white space
        m -= 1
    return a - n, b + m, left, right


def compare(x: str, part: str, at: int, whole: int, places: list[tuple[int, int, int, bool, bool]]) -> tuple[set, dict, set]:
    """Places (shift, a, b, is a chunk, stands in three places or more) of x against a text of ``whole`` characters, of which
    ``part`` starts at ``at``; x[a] meets its a - shift.

    Returns the spans to cut, whether anchors of three places or more are in one, and the places whose equal texts reach past
    ``part``, with the ends where they do (else -1).
    """
    cut: set[tuple[int, int]] = set()
    anchors: dict[int, bool] = {}
    open_: set[tuple[int, int, int, bool, int, int]] = set()
    # The last equal span, whether it's long, whether it goes on past part, and how x and part are aligned there.
    last: tuple = (0, -1, False, False, None)
    for shift, a, b, chunk, many in sorted(places):
        met = last[4] == shift and last[0] <= a and b <= last[1]
        if not met:
            i = a - shift - at
            met = x[a:b] == part[i : i + b - a]
            if met:
                lo, hi, left, right = widened(x, a, b, part, i)
                left, right = left and lo > 0 and at > 0, right and hi < len(x) and at + len(part) < whole
                last = lo, hi, len(x[lo:hi].split(None, LONG - 1)) == LONG, left or right, shift
                if left or right:
                    open_.add((shift, a, b, chunk, lo if left else -1, hi if right else -1))
        if met and (chunk or last[2]):
            cut.add(last[:2])
        if many and not chunk:
            anchors[a] = anchors.get(a, False) or (met and (last[2] or last[3]))
    return cut, anchors, open_


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def within(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether ``at`` lies inside of one of the merged spans, not at an end; -1 does."""
    i = bisect.bisect_left(spans, (at, -1)) - 1
    return at < 0 or (i >= 0 and spans[i][0] < at < spans[i][1])


def _pairs(found: DataFrame) -> DataFrame:
    """The places of repeated hashes but the first ones and those that are done, for each ZONE of the first one's document:
    d, h, d2, h2, zone, places, lo, hi (the part of that document)."""
    # As tables of their own, hashes and first places are shuffled for the joins, and Spark can split a hot hash over tasks.
    several, several_path = keep(found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c", (F.col("n") > 2).alias("many")), "repeated-hashes")
    again, again_path = keep(found.join(several, "c"), "repeated")
    first, first_path = keep(again.groupBy("c").agg(F.min(F.struct("d", "h", "a")).alias("f")), "first-places")
    pairs = again.where("NOT done").join(first, "c").where(~((F.col("d") == F.col("f.d")) & (F.col("h") == F.col("f.h")) & (F.col("a") == F.col("f.a"))))
    shift = F.col("a") - F.col("f.a")
    place = F.struct(shift.alias("shift"), "a", "b", (F.col("c") % 2 != 0).alias("chunk"), "many")
    pairs = pairs.groupBy("d", "h", F.col("f.d").alias("d2"), F.col("f.h").alias("h2"), F.floor(F.col("f.a") / ZONE).alias("zone"))
    pairs, _ = keep(pairs.agg(F.collect_set(place).alias("places"), F.min(F.col("lo") - shift.cast("long")).alias("lo"), F.max(F.col("hi") - shift.cast("long")).alias("hi")), "pairs")
    drop(found.sparkSession, several_path, again_path, first_path)
    return pairs


SPANS = "d long, h long, a int, b int, c long, done boolean, d2 long, h2 long, shift int, chunk boolean"


def _spans(pairs: DataFrame, texts: DataFrame, name: str, words: int, more: int) -> DataFrame:
    """Spans to cut (c and d2 are null), places to compare whole (d2 and so on), and runs of ``words`` + ``more`` words (hash c)
    around the anchors, of ``words`` words, that stand in three places or more; they're done if the anchor is in a span."""

    def run(batches):
        for batch in batches:
            out = []
            d, h, x, met = batch.columns
            for i in range(batch.num_rows):
                k, text = (d[i].as_py(), h[i].as_py()), x[i].as_py()
                anchors: dict[int, bool] = {}
                spans, ends = set(), []
                for m in met[i].as_py():
                    cut, some, open_ = compare(text, m["part"], m["at"], m["whole"], [tuple(p.values()) for p in m["places"]])
                    for a, done in some.items():
                        anchors[a] = anchors.get(a, False) or done
                    spans |= cut
                    ends += [(place, m["d2"], m["h2"]) for place in open_]
                spans = merged(spans)
                out += [(*k, a, b, None, None, None, None, None, None) for a, b in spans]
                out += [(*k, a, b, None, None, d2, h2, shift, chunk) for (shift, a, b, chunk, lo, hi), d2, h2 in ends if not (within(spans, lo) and within(spans, hi))]
                if anchors and more:
                    runs, chars = Runs([text]), sorted(anchors)
                    of, first, last = runs.around(chars, words, more)
                    c = (runs.hashes(first, last) & ~np.uint64(1)).view(np.int64)
                    for j, a, b, hash_ in zip(of.tolist(), runs.starts[first].tolist(), runs.ends[last].tolist(), c.tolist(), strict=True):
                        out.append((*k, a, b, hash_, anchors[chars[j]], None, None, None, None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 10
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["d", "h", "a", "b", "c", "done", "d2", "h2", "shift", "chunk"])

    # A first document that many others meet has its text sent in copies, one for each MEET of them.
    hot, hot_path = keep(pairs.groupBy("d2", "h2").agg(F.floor(F.count(F.lit(1)) / MEET).alias("top")), "first-documents")
    other = hot.join(texts.select(F.col("__tf_d").alias("d2"), F.col("__tf_h").alias("h2"), "text"), ["d2", "h2"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), "top")))
    salted = pairs.join(hot.where("top > 0"), ["d2", "h2"], "left").withColumn("salt", F.pmod(F.xxhash64("d", "h", "zone"), F.coalesce("top", F.lit(0)) + 1)).drop("top")
    size = F.length("text")
    at = F.least(F.greatest(F.col("lo"), F.lit(0)), size).cast("int")
    part = F.substring("text", at + 1, F.greatest(F.least(F.col("hi"), size).cast("int") - at, F.lit(0)))
    parts = salted.join(other.drop("top"), ["d2", "h2", "salt"])
    parts = parts.select("d", "h", F.struct("d2", "h2", "places", at.alias("at"), part.alias("part"), size.alias("whole")).alias("m"))
    met = parts.groupBy("d", "h").agg(F.collect_list("m").alias("met"))
    both = met.join(texts.select(F.col("__tf_d").alias("d"), F.col("__tf_h").alias("h"), F.col("text").alias("x")), ["d", "h"])
    spans, _ = keep(both.select("d", "h", "x", "met").mapInArrow(run, SPANS), name)
    drop(pairs.sparkSession, hot_path)
    return spans


def _kept(spans: DataFrame) -> DataFrame:
    """For each document: what stays, as (start, length) from 1, and the number of characters cut."""

    def run(batches):
        for batch in batches:
            out = []
            for d, h, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stay, at, gone = [], 0, 0
                for a, b in sorted((s["a"], s["b"]) for s in cut):
                    if a > at:
                        stay.append({"at": at + 1, "n": a - at})
                    gone += max(0, b - max(a, at))
                    at = max(at, b)
                stay.append({"at": at + 1, "n": 2**31 - 1 - at})
                out.append((d, h, stay, gone))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kept = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), kept, pa.int64()], strict=True)], names=["__tf_d", "__tf_h", "__tf_kept", "__tf_gone"])

    grouped = spans.groupBy("d", "h").agg(F.collect_set(F.struct("a", "b")).alias("cut"))
    return grouped.mapInArrow(run, "__tf_d long, __tf_h long, __tf_kept array<struct<at:int,n:int>>, __tf_gone long")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text`` and ``n_chars`` (if there) set anew; adds ``removed_chars``."""
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != "removed_chars"]
    keyed = _keys(docs.select(*columns))
    texts = keyed.where("text IS NOT NULL").select("__tf_d", "__tf_h", F.col("text").cast("string").alias("text")).repartition("__tf_d", "__tf_h").dropDuplicates(["__tf_d", "__tf_h"])
    found, found_path = keep(_places(keyed).withColumn("done", F.lit(False)), "places")
    spans, words, some = [], GRAM, found
    end = F.lit(2**31 - 1)
    for more in (LONG - GRAM) // 2, LONG - GRAM - (LONG - GRAM) // 2, 0:
        pairs = _pairs(some)
        if spans:  # texts that are equal as far as they were compared
            place = F.struct("shift", "a", "b", "chunk", F.lit(False).alias("many"))
            open_ = spans[-1].where("d2 IS NOT NULL").groupBy("d", "h", "d2", "h2", F.lit(-1).cast("long").alias("zone")).agg(F.collect_set(place).alias("places"), F.lit(0).cast("long").alias("lo"), end.cast("long").alias("hi"))
            pairs = pairs.unionByName(open_)
        drop(spark, found_path)
        release(spark)
        if spans and pairs.isEmpty():
            break
        spans.append(_spans(pairs, texts, "spans", words, more))
        release(spark)
        words += more
        # What is left at the last step is compared whole.
        far = F.lit(NEAR if words < LONG else 2**30)
        some = spans[-1].where("c IS NOT NULL").select("d", "h", "a", "b", "c", F.greatest(F.col("a") - far, F.lit(0)).alias("lo"), (F.col("b") + far).alias("hi"), "done")
    spans = functools.reduce(DataFrame.union, spans)
    kept, _ = keep(_kept(spans.where("c IS NULL AND d2 IS NULL").select("d", "h", "a", "b")), "kept")
    joined = keyed.join(kept, ["__tf_d", "__tf_h"], "left")
    text = F.expr("CASE WHEN __tf_kept IS NULL THEN text ELSE array_join(transform(__tf_kept, s -> substring(text, s.at, s.n)), '') END")
    out = joined.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__tf_kept").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns, F.coalesce("__tf_gone", F.lit(0)).cast(T.LongType()).alias("removed_chars"))
