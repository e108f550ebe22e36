"""Lines of web pages by regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_lines(html: Column) -> Column:
    """Trimmed lines with text; scripts, styles, heads and comments go, breaks and blocks end lines."""
    t = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, "(?s)<(?:script|style|head)[^>]*>.*?</(?:script|style|head)>", "")
    t = F.regexp_replace(t, "<br */?>|</?(?:p|div|li|h1|nav|article|footer|ul)[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", "")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
