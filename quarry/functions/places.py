"""All matches of a pattern with their places, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an image reference of Markdown.
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of all matches, left to right without overlaps: code points from 0, end exclusive.

    Places are sums of the lengths of matches and of what stands between them, so a pattern may look around itself; it must not match
    nothing. Null text has no array, a text without matches an empty one.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, gap: F.struct(F.char_length(gap).alias("gap"), m.alias("text")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, text: string>>").alias("out"))

    def add(so_far, m):
        low = so_far["at"] + m["gap"]
        high = low + F.char_length(m["text"])
        return F.struct(high.alias("at"), F.concat(so_far["out"], F.array(F.struct(low.alias("start"), high.alias("end"), m["text"].alias("text")))).alias("out"))

    return F.when(text.isNotNull(), F.aggregate(pairs, start, add, lambda s: s["out"]))


def image_places(text: Column) -> Column:
    """Array of (alt, path, start, end) of image references."""
    part = lambda m, group: F.regexp_extract(m["text"], IMAGE, group)
    return F.transform(matches(text, IMAGE), lambda m: F.struct(part(m, 1).alias("alt"), part(m, 2).alias("path"), m["start"].alias("start"), m["end"].alias("end")))
