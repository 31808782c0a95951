"""Volatile content that would break a prompt's prefix cache."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (kind, pattern, placeholder) in order of precedence: fixed values.
PATTERNS = (
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    ("token", r"\b(?:gh[osr]_[0-9a-zA-Z]{36,255}|sk-[0-9a-zA-Z]{48})\b", "<TOKEN>"),
    ("timestamp", r"\b\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?\b", "<TIMESTAMP>"),
    ("timestamp", r"\b1\d{9}(?:\.\d+)?\b", "<TIMESTAMP>"),
    ("hash", r"\b[0-9a-fA-F]{32,64}\b", "<HASH>"),
)


def normalize(text: Column) -> Column:
    """Placeholders for UUIDs, keys, timestamps and hashes, each pattern after the ones before it."""
    for _, pattern, placeholder in PATTERNS:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def counts(text: Column) -> dict[str, Column]:
    """Spans of each kind that don't overlap one of an earlier kind: earlier kinds are masked before a kind is counted."""
    out: dict[str, Column] = {}
    for kind, pattern, _ in PATTERNS:
        n = F.regexp_count(text, F.lit(pattern)).cast("long")
        out[kind] = out[kind] + n if kind in out else n
        text = F.regexp_replace(text, pattern, "\u0001")
    return out


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])


@F.pandas_udf(T.ArrayType(_SPAN))
def spans(texts: pd.Series) -> pd.Series:
    """Spans by position, with offsets, which no built-in function gives; an overlap goes to the earlier pattern."""
    compiled = [(k, re.compile(p)) for k, p, _ in PATTERNS]

    def of(text: str | None):
        taken = bytearray(len(text or ""))
        out = []
        for kind, pattern in compiled:
            for m in pattern.finditer(text or ""):
                if not any(taken[m.start() : m.end()]):
                    taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
                    out.append({"kind": kind, "start": m.start(), "end": m.end(), "text": m[0]})
        return sorted(out, key=lambda x: x["start"])

    return texts.map(of)
