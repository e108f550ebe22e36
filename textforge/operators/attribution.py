"""Moods of texts by lines: window scores, lines' labels, composition, polarity; and checks against labels that people gave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spans(text: Column, size: int = 80, step: int = 40) -> Column:
    """(i, a, b) of windows of ``size`` characters, ``step`` apart, up to the end of the text."""
    n = F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(i.alias("i"), (i * step).alias("a"), F.least(i * step + size, n.cast("long")).alias("b")))


def line_spans(text: Column) -> Column:
    """(line, a, b) of lines that aren't blank, by a running sum inside of the row."""
    lengths = F.transform(F.split(text, "\n"), F.length)
    starts = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + 1)))
    rows = F.zip_with(lengths, F.slice(starts, F.lit(1), F.size(lengths)), lambda n, a: F.struct(a.alias("a"), (a + n).alias("b")))
    numbered = F.transform(rows, lambda r, i: F.struct((i + 1).cast("long").alias("line"), r["a"].alias("a"), r["b"].alias("b")))
    return F.filter(numbered, lambda r: r["b"] > r["a"])


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves of the scaled value away from zero, as C and SQL round."""
    scaled = np.abs(x) * 10.0**digits
    low = np.floor(scaled)
    return np.copysign(np.where(scaled - low >= 0.5, low + 1, low) / 10.0**digits, x)


def _attribute(batch: pa.RecordBatch, key: str, text: str, labels: list[str], bias: list[float], floor: float, above: float, below: float) -> dict:
    """Columns of the payload of a batch's texts that have lines and windows; sums run by window and by line, in ascending order."""
    doc, line, begin, end, n_chars = [], [], [], [], []
    for d, t in enumerate(batch.column(text).to_pylist()):
        at = 0
        for k, part in enumerate((t or "").split("\n"), 1):
            if part:
                doc.append(d), line.append(k), begin.append(at), end.append(at + len(part))
            at += len(part) + 1
        n_chars.append(at - 1)
    doc, line, begin, end, n_chars = (np.array(x, dtype=np.int64) for x in (doc, line, begin, end, n_chars))
    scores = batch.column("scores")
    of = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(scores), 0).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(scores)
    i = flat.field("i").to_numpy(zero_copy_only=False).astype(np.int64)
    inside = (i >= 0) & (i <= np.maximum(0, -((80 - n_chars[of]) // 40)))
    order = np.flatnonzero(inside)[np.lexsort((i[inside], of[inside]))]
    of, i = of[order], i[order]
    values = [pc.fill_null(flat.field(c).cast("double"), 0.0).to_numpy(zero_copy_only=False)[order] for c in labels]
    known = [flat.field(c).is_valid().to_numpy(zero_copy_only=False)[order] for c in labels]
    few = np.bincount(of, minlength=len(batch)) > 0
    keep = few[doc]
    doc, line, begin, end = (x[keep] for x in (doc, line, begin, end))
    # Windows of a text stand together by number: each line takes a run of them.
    far = np.int64(1) << 40
    place = of * far + i
    low = np.searchsorted(place, doc * far + np.maximum((begin - 80) // 40 + 1, 0))
    many = np.maximum(np.searchsorted(place, doc * far + (end - 1) // 40, side="right") - low, 0)
    row = np.repeat(np.arange(len(doc)), many)
    window = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
    weight = (np.minimum(i[window] * 40 + 80, end[row]) - np.maximum(i[window] * 40, begin[row])).astype(float)
    total = np.bincount(row, weight, len(doc))
    with np.errstate(invalid="ignore", divide="ignore"):
        means = []
        for v, k in zip(values, known, strict=True):
            whole = np.bincount(of, v, len(batch)) / np.bincount(of, k, len(batch))
            some = np.bincount(row, k[window], len(doc)) > 0
            means.append(np.where(some, np.bincount(row, weight * v[window], len(doc)) / total, whole[doc]))
        biased = np.array([m + b for m, b in zip(means, bias, strict=True)])
        top = np.where(np.isnan(biased), -np.inf, biased)
        names = np.where(top.max(axis=0) < floor, "neutral", np.array(labels)[top.argmax(axis=0)])
        lines = np.bincount(doc, minlength=len(batch))
        sums = [np.bincount(doc, m, len(batch)) for m in means]
        every = sum(sums, 0.0)
        parts = [np.where(every < 1e-6, round(1 / len(labels), 4), _rounded(s / every, 4)) for s in sums]
        x = sums[0] / lines - sum((s / lines for s in sums[1:]), 0.0) / max(1, len(labels) - 1)
    some = np.flatnonzero(lines > 0)
    ends = np.concatenate([[0], np.cumsum(lines[some])]).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(line), pa.array(begin), pa.array(end), pa.array(names.astype(object), pa.string())], ["line", "a", "b", "label"])
    kind = np.where(x > above, "positive", np.where(x < below, "negative", "neutral"))
    return {
        key: batch.column(key).take(pa.array(some)), "lines": pa.ListArray.from_arrays(pa.array(ends), structs),
        "composition": pa.StructArray.from_arrays([pa.array(p[some], from_pandas=True) for p in parts], labels),
        "polarity": pa.array(_rounded(x[some], 6), from_pandas=True), "polarity_label": pa.array(kind[some].astype(object), pa.string()),
    }


def attributed_whole(rows: DataFrame, key: str, text: str, labels: list[str], bias: list[float], floor: float = 0.55, above: float = 0.0, below: float = -0.1) -> DataFrame:
    """As ``attributed``, of rows that carry their windows' scores: ``scores``, an array of (i, a number for each label)."""

    def each(batches):
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_pydict(_attribute(batch, key, text, labels, bias, floor, above, below))

    shape = f"{key} {rows.schema[key].dataType.simpleString()}, lines array<struct<line:bigint,a:bigint,b:bigint,label:string>>, composition struct<{','.join(f'`{c}`:double' for c in labels)}>, polarity double, polarity_label string"
    return rows.select(key, text, "scores").where(F.col(key).isNotNull()).mapInArrow(each, shape)


def attributed(rows: DataFrame, key: str, text: str, scores: DataFrame, labels: list[str], bias: list[float], floor: float = 0.55, above: float = 0.0, below: float = -0.1) -> DataFrame:
    """One row a text: its lines (line, a, b, label), composition by label, polarity and its label.

    ``scores`` has the key, the window's number i, and a column for each label; lines take the mean of the windows that overlap
    them, weighted by overlap, or that of all windows.  Sums of doubles depend on their order, so they run by window, then by line.
    """
    given = scores.where("i IS NOT NULL").groupBy(key).agg(F.collect_list(F.struct("i", *labels)).alias("scores"))
    return attributed_whole(rows.select(key, text).join(given, key), key, text, labels, bias, floor, above, below)


def slim(payload: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """The three figures that are kept for every text."""
    return payload.select(key, *[F.round(F.col("composition")[c], 6).alias(c) for c in labels[:3]])


def gate(payload: DataFrame, gold: DataFrame, key: str, labels: list[str], least: float = 0.7) -> DataFrame:
    """One row: how often the largest part of the composition is the gold label, and whether that's enough."""
    values = F.array(*[F.col("composition")[c] for c in labels])
    guess = F.element_at(F.array(*map(F.lit, labels)), F.array_position(values, F.array_max(values)).cast("int"))
    both = payload.select(key, guess.alias("guess")).join(gold, key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("guess") == F.col("gold")).cast("double")), 6).alias("share")).withColumn("passed", F.col("share") >= least)


def label_sets(gold: DataFrame, weak: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(label, key, kind): texts of each label, as people say, or as a weak source says of texts that no one judged."""
    each = lambda df, kind: df.select(key, F.lit(kind).alias("kind"), F.explode(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in labels])).alias("label")).where("label IS NOT NULL")
    return each(gold, "gold").unionByName(each(weak.join(gold.select(key), key, "left_anti"), "weak")).select("label", key, "kind")
