"""Column functions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import nfc

#: Runs of Devanagari letters, or of ASCII letters and digits.
TOKEN = "[\\x{0900}-\\x{097F}]+|[A-Za-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def fold(text: Column) -> Column:
    """NFC, lower case, sharp s as ss, everything but letters, digits and underscores as one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(nfc(text)), F.lit("ß"), F.lit("ss")), "[^\\p{L}\\p{N}_\\x{0900}-\\x{097F}]+", " "))


def spaced(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(spaced(nfc(text))), 256)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def script(text: Column) -> Column:
    """devanagari, romanized, mixed or unknown."""
    d, r = F.coalesce(text, F.lit("")).rlike("[\\x{0900}-\\x{097F}]"), F.coalesce(text, F.lit("")).rlike("[A-Za-z]")
    return F.when(d & r, "mixed").when(d, "devanagari").when(r, "romanized").otherwise("unknown")


def letter_ratio(text: Column, kind: str) -> Column:
    """Share of letters that are of ``kind`` (a character class); 0 where there are no letters."""
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\p{L}]", ""))
    ours = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{kind}]", ""))
    return F.when(letters > 0, ours / letters).otherwise(F.lit(0.0))


def dedupe_key(artist: Column, title: Column, seconds: Column) -> Column:
    """fold(artist)|fold(title)|five-second bucket, the last one empty without a positive duration."""
    bucket = F.when(seconds > 0, F.floor(seconds / 5).cast("string")).otherwise(F.lit(""))
    return F.concat(fold(artist), F.lit("|"), fold(title), F.lit("|"), F.coalesce(bucket, F.lit("")))


def seconds(clock: Column) -> Column:
    """h:m:s as seconds; 0 for empty or malformed values."""
    parts = F.transform(F.split(F.coalesce(clock, F.lit("")), ":"), lambda x: x.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.coalesce(total, F.lit(0.0))


def tolerant_id(value: Column) -> Column:
    """"1746.0" as 1746; nan, none, empty and other texts as null."""
    return F.trim(value).try_cast("double").try_cast("long")


def excerpt(text: Column, head: int = 6, tail: int = 2, most: int = 600) -> Column:
    """The first and last lines of a longer text around an ellipsis, joined by " / "."""
    all_lines = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(all_lines)
    some = F.when(n <= head + tail, all_lines).otherwise(F.concat(F.slice(all_lines, 1, head), F.array(F.lit("…")), F.slice(all_lines, F.greatest(n - tail + 1, F.lit(1)), tail)))
    return F.substring(F.array_join(some, " / "), 1, most)
