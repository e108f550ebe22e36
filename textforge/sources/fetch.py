"""Answers of services through a cache, with retries, pauses and a breaker; and pages of them as one table.

The transport is the caller's: a function of (url, parameters) that returns (status, text).  Nothing here opens a connection.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession

RETRY = frozenset({429, 500, 502, 503, 504})


class Unavailable(RuntimeError):
    """A service that failed too often, or doesn't answer."""


@dataclass
class Cached:
    """Texts by address and parameters, kept in a folder."""

    transport: Callable[[str, dict], tuple[int, str]]
    folder: str
    attempts: int = 4
    pause: float = 0.5
    interval: float = 0.0
    failures: int = 10
    rest: float = 300.0
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: dict[str, float] = field(default_factory=dict)
    failed: dict[str, int] = field(default_factory=dict)
    closed: dict[str, float] = field(default_factory=dict)

    def key(self, url: str, params: dict) -> str:
        return hashlib.sha1(f"{url}?{urlencode(sorted(params.items()))}".encode()).hexdigest()

    def text(self, url: str, params: dict | None = None, refresh: bool = False) -> str | None:
        """The answer's text; None for a status that isn't worth another attempt."""
        params, host = params or {}, urlsplit(url).netloc
        path = os.path.join(self.folder, self.key(url, params))
        if not refresh and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return f.read()
        if self.closed.get(host, 0.0) > self.clock():
            raise Unavailable(host)
        for attempt in range(self.attempts):
            wait = self.last.get(host, -1e18) + self.interval - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last[host] = self.clock()
            status, body = self.transport(url, params)
            if status == 200:
                self.failed[host] = 0
                os.makedirs(self.folder, exist_ok=True)
                with open(f"{path}.part", "w", encoding="utf-8") as f:
                    f.write(body)
                os.replace(f"{path}.part", path)
                return body
            if status not in RETRY:
                return None
            self.failed[host] = self.failed.get(host, 0) + 1
            if self.failed[host] >= self.failures:
                self.closed[host] = self.clock() + self.rest
                self.failed[host] = 0
                raise Unavailable(host)
            if attempt + 1 < self.attempts:
                self.sleep(self.pause * 2**attempt * (1 + random.random() / 4))
        raise Unavailable(host)

    def json(self, url: str, params: dict | None = None, refresh: bool = False):
        body = self.text(url, params, refresh)
        return None if body is None else json.loads(body)


def pages(get: Callable[[int], list], size: int, most: int = 20) -> Iterator[dict]:
    """Items of pages 1, 2, ... until one is short, or ``most`` are read."""
    for number in range(1, most + 1):
        items = get(number) or []
        yield from items
        if len(items) < size:
            return


def catalog(spark: SparkSession, tracks: Iterator[dict], source: str) -> DataFrame:
    """Candidate rows of a catalog's tracks, which may name things by various keys."""
    first = lambda t, *names: next((t[n] for n in names if t.get(n) not in (None, "")), None)
    rows = []
    for t in tracks:
        artist, album = first(t, "artist", "artistName"), first(t, "album", "collectionName", "albumName")
        artist = artist.get("name") if isinstance(artist, dict) else artist
        album = album.get("title") if isinstance(album, dict) else album
        seconds = first(t, "duration")
        millis = t.get("trackTimeMillis")
        title = first(t, "title", "trackName", "name")
        if title and artist:
            rows.append((source, str(first(t, "id", "trackId")), artist, title, album, int(seconds) if seconds else millis // 1000 if millis else None, first(t, "preview", "previewUrl"), t.get("isrc")))
    return spark.createDataFrame(rows, "source string, source_id string, artist string, title string, album string, duration_s int, preview_url string, isrc string")
