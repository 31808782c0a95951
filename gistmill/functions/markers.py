"""Markers of dropped content: <<ccr:HASH N reason>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import content_hash

#: The marker's grammar, and the words before it in a text: fixed values but for the configurable prefix.
PATTERN = r"<<ccr:([0-9a-f]+)\s+(\d+)(?:\s+([^\s>]+))?>>"
PREFIX = "[elided]"
DROPPED_KEY, SENTINEL_KEY = "_ccr_dropped", "__elided__"


def marker(key: Column, count: Column, reason: Column | str = "elided") -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.concat(F.lit("<<ccr:"), key, F.lit(" "), count.cast("string"), F.lit(" "), reason, F.lit(">>"))


def text_marker(lines: Column, reason: str) -> Column:
    """One line that stands for dropped lines; the original is the lines joined by newlines."""
    n = F.size(lines)
    return F.concat(F.lit(PREFIX + " "), n.cast("string"), F.lit(f" {reason} "), marker(content_hash(F.array_join(lines, "\n")), n, reason))


def find_markers(text: Column) -> Column:
    """array<struct<hash, count, reason>> of all markers; a marker without a reason has 'elided'."""
    all_ = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.transform(
        all_,
        lambda m: F.struct(
            F.regexp_extract(m, PATTERN, 1).alias("hash"),
            F.regexp_extract(m, PATTERN, 2).cast("long").alias("count"),
            F.when(F.regexp_extract(m, PATTERN, 3) == "", "elided").otherwise(F.regexp_extract(m, PATTERN, 3)).alias("reason"),
        ),
    )


def parse_marker(text: Column) -> Column:
    """The first marker, or null."""
    return F.get(find_markers(text), F.lit(0))


def strip_markers(text: Column) -> Column:
    """Without markers; runs of blanks become one, blanks before a line's end go."""
    out = F.regexp_replace(text, PATTERN, "")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return F.regexp_replace(out, r"[ \t]+(\n|\z)", "$1")


def json_sentinel(key: Column, dropped: Column, kept: Column, total: Column, reason: str = "middle-elided") -> Column:
    """The JSON object that stands for dropped items of an array."""
    inner = F.struct(dropped.alias("dropped"), kept.alias("kept"), total.alias("total"), F.lit(reason).alias("reason"), key.alias("hash"))
    return F.to_json(F.struct(marker(key, dropped, reason).alias(DROPPED_KEY), inner.alias(SENTINEL_KEY)))
