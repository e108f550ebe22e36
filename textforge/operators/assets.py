"""Asset graphs, runs of assets, and bootstrap intervals."""

from __future__ import annotations

import math
import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Asset:
    """A named step; ``action`` makes it, ``exists`` tells whether it is there."""

    name: str
    needs: list[str] = field(default_factory=list)
    action: Callable[[], object] | None = None
    exists: Callable[[], bool] = lambda: False
    retries: int = 0


def topological(graph: dict[str, list[str]]) -> list[str]:
    """Names so that each comes after what it needs, by name among equals; ValueError for cycles and unknown names."""
    left = {n: set(d) for n, d in graph.items()}
    if unknown := {d for ds in left.values() for d in ds} - left.keys():
        raise ValueError(f"unknown: {sorted(unknown)}")
    out = []
    while left:
        ready = sorted(n for n, d in left.items() if not d)
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        for n in ready:
            del left[n]
        for d in left.values():
            d.difference_update(ready)
        out += ready
    return out


def descendants(graph: dict[str, list[str]], names: set[str]) -> set[str]:
    found = set(names)
    while more := {n for n, d in graph.items() if n not in found and found & set(d)}:
        found |= more
    return found


def run(assets: list[Asset], force: bool = False, dry: bool = False, wait: float = 0.0) -> dict[str, str]:
    """Status of each asset: ok, skipped (there already), planned, external (no action), failed, or blocked by a failure."""
    by_name = {a.name: a for a in assets}
    status: dict[str, str] = {}
    for name in topological({a.name: a.needs for a in assets}):
        a = by_name[name]
        if any(status[d] in ("failed", "blocked") for d in a.needs):
            status[name] = "blocked"
        elif a.action is None:
            status[name] = "external"
        elif a.exists() and not force:
            status[name] = "skipped"
        elif dry:
            status[name] = "planned"
        else:
            for attempt in range(a.retries + 1):
                try:
                    a.action()
                    status[name] = "ok"
                    break
                except Exception:
                    status[name] = "failed"
                    time.sleep(wait * 2**attempt)
    return status


def script(arguments: list[str], seconds: float = 3600.0) -> Callable[[], str]:
    """An action that runs a command and returns the end of its output; RuntimeError if it fails or takes too long."""

    def act() -> str:
        try:
            done = subprocess.run(arguments, capture_output=True, text=True, timeout=seconds)
        except subprocess.TimeoutExpired as e:
            raise RuntimeError(f"{arguments[0]} took more than {seconds} s") from e
        if done.returncode:
            raise RuntimeError(f"{arguments[0]} ended with {done.returncode}: {done.stderr[-500:]}")
        return done.stdout[-500:]

    return act


def history(old: DataFrame, statuses: dict[str, str], run: str, at: str) -> DataFrame:
    """The history (run, asset, status, at) with the outcome of a run behind it."""
    return old.unionByName(old.sparkSession.createDataFrame([(run, a, s, at) for a, s in statuses.items()], old.schema))


def last_statuses(rows: DataFrame) -> DataFrame:
    """(asset, status, at, failed_at): each asset's latest status, and when it failed last."""
    latest = F.max(F.struct("at", "run", "status")).alias("m")
    return rows.groupBy("asset").agg(latest, F.max(F.when(F.col("status") == "failed", F.col("at"))).alias("failed_at")).select("asset", "m.status", "m.at", "failed_at")


def paired_bootstrap(rows: DataFrame, key: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """(mean, low, high, positive, n) of paired differences ``x``: the interval is that of the means of resamples.

    A resample counts each row Poisson(1) times, drawn from a hash of key, seed and resample, so reruns and other partitions
    agree and no row is looked up.  Equal differences are one row with a weight first where they have one key.  A row's draws are summed
    in arrays, so that a task sends one partial sum for each resample.  ``positive`` is the share of differences above 0.
    """
    names = F.sequence(F.lit(0), F.lit(resamples - 1))
    u = lambda i: F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed), i), 11) / float(1 << 53)
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(1, 20):
        total += p
        steps.append(total)
        p /= k
    edges = F.array(*map(F.lit, steps))
    times = lambda v: F.size(F.filter(edges, lambda e: e < v))
    draws = rows.select("x", F.posexplode(F.transform(names, lambda i: times(u(i)))).alias("b", "k")).where("k > 0")
    means = draws.groupBy("b").agg((F.sum(F.col("x") * F.col("k")) / F.sum("k")).alias("m"))
    interval = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    facts = rows.agg(F.avg("x").alias("mean"), F.avg((F.col("x") > 0).cast("double")).alias("positive"), F.count(F.lit(1)).alias("n"))
    return facts.join(interval, F.lit(True)).select("mean", "low", "high", "positive", "n")
