"""Classification of text blocks into nine content types, in projections of built-in functions."""

from __future__ import annotations

import csv
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import split_lines, strip

#: Patterns and tag names of the classes: fixed values. (?d) makes ^ match after \n alone.
LOG_LINE = r"(?imd)^\s*(?:\[?\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|\[?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b)"
DIFF = r"(?md)^(?:diff --git |@@ -\d|index [0-9a-f]+\.\.|\+\+\+ |--- )"
MARKDOWN = r"(?md)^(?:#{1,6}\s|\s*[-*+]\s|\s*\d+\.\s|```|>\s)"
KEYWORD = r"\b(?:def|class|import|from|function|const|let|var|return|public|private|package|func|fn|impl|module|namespace)\b"
SYMBOL = r"[{};]|=>|->|::|==|!=|\+="
SEARCH_HIT = r"(?md)^\s*\d+[:\-]"
HTML_DOC = r"(?i)^(?:<!doctype\s+html\b|<html[\s>])"
HTML_TAG = r"</?([a-zA-Z][a-zA-Z0-9]*)\b"
HTML_TAGS = (
    "html head body title meta link script style div span p a ul ol li table thead tbody tr td th h1 h2 h3 h4 h5 h6 br hr img nav header footer "
    "section article aside main form input button strong em b i pre code blockquote"
).split()
DELIMITERS = (",", ";", "\t", "|")
TYPES = ("json", "html", "code", "log", "diff", "search", "csv", "markdown", "text")


@F.pandas_udf(T.BooleanType())
def _parses(texts: pd.Series) -> pd.Series:
    """Whether Python's json accepts a text; null gives false. Built-in parsers are looser or stricter."""

    def ok(t: str | None) -> bool:
        try:
            return t is not None and (json.loads(t) is None or True)
        except (ValueError, RecursionError):
            return False

    return texts.map(ok).astype(bool)


def is_json(text: Column) -> Column:
    """Only texts that begin with a brace or bracket go to Python."""
    s = strip(text)
    return _parses(F.when(F.substring(s, 1, 1).isin("{", "["), s))


def _constant_fields(sample: Column, d: str) -> Column:
    """Whether lines without quotes have one number of fields, two or more, and neither edge is blank in all of them."""
    fields = F.transform(sample, lambda line: F.split(line, "\\" + d if d == "|" else d, -1))
    n = F.array_distinct(F.transform(fields, F.size))
    blank = lambda at: F.forall(fields, lambda f: strip(F.element_at(f, at)) == "")
    return (F.size(n) == 1) & (F.get(n, F.lit(0)) >= 2) & ~blank(1) & ~blank(-1)


@F.pandas_udf(T.BooleanType())
def _quoted_table(samples: pd.Series) -> pd.Series:
    """_constant_fields() under any delimiter for lines with quotes, whose rules only a parser follows; null gives false."""

    def table(lines, d: str) -> bool:
        try:
            rows = list(csv.reader(lines, delimiter=d))
        except csv.Error:
            return False
        widths = {len(r) for r in rows}
        return len(rows) == len(lines) and len(widths) == 1 and widths.pop() >= 2 and any(r[0].strip() for r in rows) and any(r[-1].strip() for r in rows)

    return samples.map(lambda lines: lines is not None and any(table([str(x) for x in lines], d) for d in DELIMITERS)).astype(bool)


def _decided(c: dict[str, Column]) -> Column:
    """struct<content_type, confidence>: the first class in order whose signals hold."""
    n = c["n"]
    score = c["keywords"] + 0.5 * c["symbols"]
    density = score / F.greatest(n, F.lit(1))

    def is_(kind: str, confidence) -> Column:
        return F.struct(F.lit(kind).alias("content_type"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"))

    return (
        F.when(c["blank"], is_("text", 1.0))
        .when(c["json"], is_("json", 0.99))
        .when(c["html"], is_("html", 0.97))
        .when(c["tags"] >= 3, is_("html", 0.85))
        .when(c["diff"], is_("diff", 0.95))
        .when((n >= 2) & (c["log"] / n >= 0.4), is_("log", F.least(F.lit(0.95), 0.6 + c["log"] / n)))
        .when(c["table"], is_("csv", F.least(F.lit(0.9), 0.6 + n / 50)))
        .when((n >= 3) & (c["search"] / n >= 0.5), is_("search", F.least(F.lit(0.9), 0.55 + c["search"] / n)))
        .when((score >= 3) & (density >= 0.8) & (score >= c["markdown"]) & ((n >= 2) | (c["symbols"] >= 2)), is_("code", F.least(F.lit(0.9), 0.5 + density / 4)))
        .when(c["markdown"] >= 2, is_("markdown", F.least(F.lit(0.85), 0.5 + c["markdown"] / n)))
        .otherwise(is_("text", 0.6))
    )


def detected(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with detected, a struct<content_type, confidence> of the column `text`. A null text is empty.

    Each signal is a column of its own, computed once: what several signals need (lines, the text after leading space)
    in one projection, the counts in the next, then the decision. Python gets only texts that begin like JSON, and lines
    with quotes. Of over 40 lines the first and last 20 tell whether a text is a table.
    """
    keep = [F.col(f"`{c}`") for c in texts.columns if c != "detected"]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = texts.select(*keep, t.alias("__t"), split_lines(t).alias("__ls"), F.regexp_replace(t, r"^[\s\x1c-\x1f\x85\p{Z}]+", "").alias("__front"))
    t, ls, front, n = F.col("__t"), F.col("__ls"), F.col("__front"), F.size("__ls")
    sample = F.when(n <= 40, ls).otherwise(F.concat(F.slice(ls, 1, 20), F.slice(ls, F.greatest(n - 19, F.lit(1)), F.lit(20))))
    able = (n >= 3) & ~F.ltrim(F.get(ls, F.lit(0))).rlike(r"^[{\[]")
    hits = lambda pattern: F.regexp_count(t, F.lit(pattern))
    tags = F.transform(F.regexp_extract_all(F.substring(front, 1, 2048), F.lit(HTML_TAG), F.lit(1)), F.lower)
    known = F.size(F.array_intersect(F.array_distinct(tags), F.array(*map(F.lit, HTML_TAGS))))
    signals = {
        "n": n, "blank": front == "", "json": is_json(t), "html": front.startswith("<") & front.rlike(HTML_DOC),
        "tags": F.when(front.startswith("<"), known).otherwise(0), "diff": t.rlike(DIFF), "log": hits(LOG_LINE), "search": hits(SEARCH_HIT),
        "markdown": hits(MARKDOWN), "symbols": hits(SYMBOL), "keywords": hits(KEYWORD), "sample": F.when(able, sample),
    }
    counted = lines.select(*keep, *[c.alias(f"__{k}") for k, c in signals.items()])
    quoted = F.exists("__sample", lambda x: F.contains(x, F.lit('"')))
    counted = counted.withColumn("__quoted", F.coalesce(quoted, F.lit(False)))
    plain = _constant_fields(F.col("__sample"), DELIMITERS[0])
    for d in DELIMITERS[1:]:
        plain = plain | _constant_fields(F.col("__sample"), d)
    table = F.when(F.col("__quoted"), _quoted_table(F.when(F.col("__quoted"), F.col("__sample")))).when(F.col("__sample").isNotNull(), plain).otherwise(False)
    counted = counted.withColumn("__table", F.coalesce(table, F.lit(False)))
    return counted.select(*keep, _decided({k: F.col(f"__{k}") for k in [*signals, "table"] if k != "sample"}).alias("detected"))
