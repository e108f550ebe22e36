"""Contracts, budgets and metrics of tables, each in one pass of conditional counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What a column must be: int, float or str; its range, allowed values and pattern."""

    kind: str
    nullable: bool = True
    least: float | None = None
    most: float | None = None
    allowed: tuple = ()
    pattern: str | None = None


@dataclass(frozen=True)
class Contract:
    name: str
    fields: dict[str, Field]
    key: tuple[str, ...] = ()
    required: tuple[str, ...] = field(default=())


def checks(contract: Contract, columns: list[str]) -> dict[str, Column]:
    """Conditions that a row breaks, by check name."""
    out: dict[str, Column] = {}
    for name, f in contract.fields.items():
        if name not in columns:
            continue
        c = F.col(name)
        blank = c.isNull() | (F.trim(c.cast("string")) == "")
        if not f.nullable:
            out[f"{name}:not_null"] = blank
        if f.kind in ("int", "float"):
            number = c.cast("string").try_cast("double")
            out[f"{name}:numeric"] = ~blank & number.isNull()
            if f.kind == "int":
                out[f"{name}:integral"] = number.isNotNull() & (number % 1 != 0)
            if f.least is not None:
                out[f"{name}:minimum"] = number < f.least
            if f.most is not None:
                out[f"{name}:maximum"] = number > f.most
        if f.allowed:
            out[f"{name}:allowed"] = ~blank & ~c.cast("string").isin([str(a) for a in f.allowed])
        if f.pattern:
            out[f"{name}:pattern"] = ~blank & ~c.cast("string").rlike(f"^(?:{f.pattern})$")
    return out


def validate(rows: DataFrame, contract: Contract, most: int = 5) -> DataFrame:
    """(check, failures, examples): one row for each check, and missing or extra columns, with the smallest keys that fail."""
    found = checks(contract, rows.columns) or {"rows:any": F.lit(False)}
    keys = [c for c in contract.key if c in rows.columns]
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in keys]) if keys else F.lit(None).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(bad, F.lit(False)).alias("bad")) for n, bad in found.items()]))
    flat = rows.select(key.alias("k"), each.alias("c")).select("k", "c.check", "c.bad")
    counts = flat.groupBy("check").agg(F.count_if("bad").alias("failures"))
    # Only the first few keys of a check are ever held: each task keeps that many before they're joined.
    few = flat.where("bad AND k IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("check").orderBy("k"))).where(F.col("n") <= most)
    some = few.groupBy("check").agg(F.array_sort(F.collect_list("k")).alias("examples"))
    names = rows.sparkSession.createDataFrame([(n,) for n in found], "check string")
    out = names.join(counts, "check", "left").join(some, "check", "left").select("check", F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
    if keys and len(keys) == len(contract.key):
        twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key.alias("k"), "n")
        first = twice.orderBy("k").limit(most).agg(F.array_sort(F.collect_list("k")).alias("examples"))
        total = twice.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("failures"))
        out = out.union(total.join(first, F.lit(True)).select(F.lit("key:unique"), "failures", "examples"))
    missing = [c for c in contract.fields if c not in rows.columns]
    extra = [c for c in rows.columns if c not in contract.fields]
    columns = [("columns:missing", len(missing), missing[:most]), ("columns:extra", len(extra), extra[:most])]
    return out.union(rows.sparkSession.createDataFrame(columns, "check string, failures long, examples array<string>"))


def budgets(metrics: DataFrame, limits: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """(metric, value, ok) for limits (metric, least, most); a metric without a value fails."""
    known = metrics.sparkSession.createDataFrame(limits, "metric string, least double, most double")
    rows = known.join(metrics, "metric", "left")
    ok = F.col("value").isNotNull() & (F.col("least").isNull() | (F.col("value") >= F.col("least"))) & (F.col("most").isNull() | (F.col("value") <= F.col("most")))
    return rows.select("metric", "value", ok.alias("ok"))
