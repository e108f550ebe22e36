"""Choosing lines that cover a vocabulary, and replacing known typing errors."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_cover(lines: dict, weight: dict[str, float], k: int) -> list:
    """Up to ``k`` keys of ``lines`` (key: tokens), each adding the most weight of tokens not covered yet, first keys among equals.

    For a list that a person will read: it's held by the caller.  A gain only ever falls, so a line is scored anew when it's on top.
    """
    covered: set[str] = set()
    gain = lambda tokens: sum(weight.get(t, 0.0) for t in set(tokens) - covered)
    order = {key: i for i, key in enumerate(lines)}
    heap = [(-gain(tokens), order[key], key) for key, tokens in lines.items()]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < k:
        _, at, key = heapq.heappop(heap)
        now = gain(lines[key])
        if now <= 0:
            continue
        if heap and (-now, at) > heap[0][:2]:
            heapq.heappush(heap, (-now, at, key))
            continue
        out.append(key)
        covered.update(lines[key])
    return out


def cover_pool(lines: DataFrame, key: str, text: str, tokens: Column, size: int) -> tuple[dict, dict[str, float]]:
    """The ``size`` lines with the most frequent tokens' mass, and token counts of all lines that matter for them."""
    words = lines.select(F.col(key).alias("key"), tokens.alias("w"))
    counts = words.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    each = words.select("key", F.explode(F.array_distinct("w")).alias("t")).join(counts, "t")
    best = each.groupBy("key").agg(F.sum("n").alias("mass")).orderBy(F.desc("mass"), "key").limit(size)
    rows = each.join(F.broadcast(best), "key").groupBy("key", "mass").agg(F.collect_list(F.struct("t", "n")).alias("w")).orderBy(F.desc("mass"), "key").collect()
    weight = {p.t: float(p.n) for r in rows for p in r.w}
    return {r.key: sorted(p.t for p in r.w) for r in rows}, weight


def typo_maps(rows: list[tuple[str, str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """(tokens, phrases) of rows (kind, typo, right form); rows that are blank, of another kind or change nothing are skipped."""
    tokens, phrases = {}, {}
    for kind, typo, right in rows:
        typo, right = (typo or "").strip(), (right or "").strip()
        if typo and right and typo != right:
            if kind == "token" and " " not in typo:
                tokens[typo] = right
            elif kind == "phrase" and " " in typo:
                phrases[typo] = right
    return tokens, phrases


def map_phrases(tokens: Column, phrases: dict[str, str]) -> Column:
    """Tokens with phrases replaced: longest first, from left to right, whole tokens only."""
    text = F.concat(F.lit("  "), F.array_join(tokens, "  "), F.lit("  "))  # two blanks, so that neighbours share none
    for typo in sorted(phrases, key=lambda p: (-len(p.split()), p)):
        text = F.replace(text, F.lit(" " + "  ".join(typo.split()) + " "), F.lit(" " + "  ".join(phrases[typo].split()) + " "))
    return F.filter(F.split(text, " +"), lambda t: t != "")


def map_tokens(tokens: Column, mapping: dict[str, str], may: Column | None = None) -> Column:
    """Tokens replaced one by one; only those that the map column ``may`` (token: allowed) allows, if there is one."""
    if not mapping:
        return tokens
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    new = lambda t: F.coalesce(F.try_element_at(table, t), t)
    return F.transform(tokens, lambda t: new(t) if may is None else F.when(F.coalesce(F.try_element_at(may, t), F.lit(False)), new(t)).otherwise(t))


def map_rare(postings: DataFrame, key: str, mapping: DataFrame, most: int = 10) -> DataFrame:
    """Postings (key, term, tf) with misspelt terms (mapping: term, right) of at most ``most`` documents under their right form."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= most)
    rare = mapping.join(df, "term").select("term", "right")
    mapped = postings.join(rare, "term", "left").select(key, F.coalesce("right", "term").alias("term"), "tf")
    return mapped.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def map_text(text: Column, mapping: dict[str, str]) -> Column:
    """A text with misspelt words and phrases replaced, longest first, where no letter or sign of the script touches them."""
    for typo in sorted(mapping, key=lambda p: (-len(p), p)):
        text = F.regexp_replace(text, f"(?<![\\w\\x{{0900}}-\\x{{097F}}])\\Q{typo}\\E(?![\\w\\x{{0900}}-\\x{{097F}}])", F.lit(mapping[typo].replace("\\", "\\\\").replace("$", "\\$")))
    return text
