"""Sites as sources: what an adapter has to do, and titles and artists out of page titles and addresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fetch import Cached
from .html import content_lines


class Adapter(Protocol):
    """A site: its domain, the addresses of its pages, and what a page (page_id, url, html) holds."""

    domain: str

    def discover(self, client: Cached) -> Iterator[str]: ...

    def parse(self, pages: DataFrame) -> DataFrame: ...


ADAPTERS: dict[str, Callable[[], Adapter]] = {}


def register(domain: str):
    """Make an adapter known by its domain."""

    def put(make: Callable[[], Adapter]):
        if domain in ADAPTERS:
            raise ValueError(f"{domain} has an adapter")
        ADAPTERS[domain] = make
        return make

    return put


def crawl(spark: SparkSession, domain: str, client: Cached, most: int = 0) -> DataFrame:
    """Parsed pages of a site, fetched through the client's cache; ``most`` above 0 stops after as many pages."""
    adapter = ADAPTERS[domain]()
    rows = []
    for i, url in enumerate(sorted(set(adapter.discover(client)))):
        if most and i >= most:
            break
        html = client.text(url)
        if html is not None:
            rows.append((i, url, html))
    return adapter.parse(spark.createDataFrame(rows, "page_id long, url string, html string"))


#: Ways to write a title and an artist in one line, in the order they're tried: groups 1 and 2.
TITLES = (
    "(?i)^(.+?)\\s+lyrics?\\s+in\\s+\\w+\\s*[|-]?\\s*(?:by\\s+)?(.+)$",
    "(?i)^(.+?)\\s+(?:song\\s+)?lyrics?\\s+(?:by|-|\\|)\\s+(.+)$",
    "^(.+?)\\s*\\|\\s*([^|]+?)\\s*(?:\\|.*)?$",
    "(?i)^(.+?)\\s+[-–]\\s+(?!lyrics?\\s*$)(.+?)(?:\\s+lyrics\\s*(?:&\\s*chords)?)?$",
)


def title_artist(raw: Column) -> Column:
    """(title, artist) of a page's title by the first of TITLES that it fits; else what's left without a lyrics marker, and none."""
    raw = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "\\s+", " "))
    edge = lambda c: F.regexp_replace(c, "^[ |-]+|[ |-]+$", "")
    title = edge(F.regexp_replace(raw, "(?i)\\s*[-|]?\\s*lyrics?\\s*$", ""))
    out = F.struct(title.alias("title"), F.lit("").alias("artist"))
    for pattern in reversed(TITLES):
        fits = F.struct(edge(F.regexp_extract(raw, pattern, 1)).alias("title"), edge(F.regexp_extract(raw, pattern, 2)).alias("artist"))
        out = F.when(raw.rlike(pattern), fits).otherwise(out)
    return out


def slug_title(url: Column) -> Column:
    """The last part of an address as words."""
    last = F.regexp_extract(F.regexp_replace(url, "[?#].*$|/+$", ""), "([^/]+)$", 1)
    plain = F.regexp_replace(F.regexp_replace(last, "(?i)\\.html?$", ""), "(?i)[-_]lyrics?$", "")
    return F.initcap(F.trim(F.regexp_replace(plain, "[-_]+", " ")))


def allowed(url: Column, hosts: list[str], prefix: str, forbidden: list[str]) -> Column:
    """Whether an address is of one of the hosts, below the prefix, and free of the forbidden parts; bad addresses aren't."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    bad = F.lit(False)
    for part in forbidden:
        bad = bad | F.contains(path, F.lit(part))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts), F.lit(False)) & path.startswith(prefix) & ~bad


def page_lines(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", content_lines(F.col("html")).alias("lines"))
