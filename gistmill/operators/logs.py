"""Logs: levels, context windows, runs of dropped lines and collapsed repeats, as windows over exploded lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markers import text_marker
from ..functions.text import content_hash, strip

#: Patterns of formats, of line classes, and of what tells equal-looking lines apart: fixed values.
FORMATS = (
    ("pytest", r"(?md)={3,}.*test session starts|^PASSED|^FAILED|::"),
    ("cargo", r"(?md)^\s*Compiling \w|^error\[E\d+\]|^\s*Running .*target"),
    ("jest", r"(?md)^\s*(?:PASS|FAIL)\s+\S+\.(?:test|spec)\.[jt]sx?"),
    ("npm", r"(?md)^npm (?:ERR!|WARN)|node_modules"),
    ("make", r"(?md)^make(?:\[\d+\])?:|^g?cc \S"),
)
ERROR = r"(?i)\b(?:error|fatal|critical|panic|exception|traceback|fail(?:ed|ure)?|assert(?:ion)?error|err!)\b|^E\s|^\s*error\[E\d+\]"
WARN = r"(?i)\b(?:warn(?:ing)?|deprecat)\b|^npm WARN"
DEBUG = r"(?i)\b(?:debug|trace|verbose)\b"
SUMMARY = r"(?i)\b\d+\s+(?:passed|failed|error|skipped|warning)|^Tests:|^test result:|BUILD (?:SUCCESS|SUCCESSFUL|FAILED)|^={3,}.*(?:passed|failed|summary)|^Summary"
DISTINCT = r"0x[0-9a-fA-F]+|\b[0-9a-fA-F]{8,}\b|\b\d{3,}\b|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
LEVELS = {"DEBUG": 0, "INFO": 1, "SUMMARY": 2, "WARN": 3, "ERROR": 4}
FEWEST = 8


def log_format(text: Column) -> Column:
    out = F.lit("generic")
    for name, pattern in reversed(FORMATS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def level(line: Column) -> Column:
    """0 debug, 1 info, 2 summary, 3 warning, 4 error; summaries are recognised before errors."""
    return F.when(line.rlike(SUMMARY), 2).when(line.rlike(ERROR), 4).when(line.rlike(WARN), 3).when(line.rlike(DEBUG), 0).otherwise(1)


_HEADER = re.compile(r"\s*Traceback \(most recent call last\):", re.IGNORECASE)
_CHAIN = re.compile(r"\s*(?:During handling of the above exception|The above exception was the direct cause of the following exception):", re.IGNORECASE)
_FRAME = re.compile(r"\s+at\s+\S+")


def traced(lines: list[str]) -> list[bool]:
    """Which lines belong to Python or JavaScript stack traces: an automaton over the lines.

    A Python trace runs from its header over indented lines to the first other line, which is its message; where another
    header or a chaining sentence follows over blank lines, it goes on there. A JavaScript trace is the frames (`at ...`),
    blank lines between frames, and the line before the first frame.
    """
    n, out = len(lines), [False] * len(lines)
    following = [n] * (n + 1)  # of each line the first at or after it that isn't blank
    for i in range(n - 1, -1, -1):
        following[i] = i if lines[i].strip() else following[i + 1]

    def chained(i: int) -> bool:
        return i < n and bool(_HEADER.match(lines[i]) or _CHAIN.match(lines[i]))

    i = 0
    while i < n:
        if _HEADER.match(lines[i]):
            out[i] = True
            i += 1
            while i < n:
                blank = not lines[i].strip()
                if not blank and (lines[i][0] == " " or chained(i) or re.match(r"\s*File\s+\"[^\"]+\",\s+line\s+\d+", lines[i], re.IGNORECASE)):
                    out[i] = True
                    i += 1
                    continue
                after = following[i if blank else i + 1]
                if not blank:
                    out[i] = True
                if not chained(after):
                    i += not blank
                    break
                for j in range(i, after + 1):
                    out[j] = True
                i = after + 1
        elif _FRAME.match(lines[i]):
            if i and not out[i - 1] and lines[i - 1].strip() and not lines[i - 1].strip().startswith("at "):
                out[i - 1] = True
            while i < n:
                after = following[i]
                if after >= n or not _FRAME.match(lines[after]):
                    break
                for j in range(i, after + 1):
                    out[j] = True
                i = after + 1
        else:
            i += 1
    return out


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def tracebacks(lines: pd.Series) -> pd.Series:
    """traced() for arrays of lines; only blocks that hold a trace's first words need go through it."""
    return lines.map(lambda x: None if x is None else traced(list(x)))


def flagged(blocks: DataFrame, context: int = 1) -> DataFrame:
    """(block_id, idx, line, level, keep) for blocks (block_id, text): kept are the first and last line, lines of level
    summary and above and of traces, and `context` lines around these."""
    lines = F.split("text", "\n", -1)
    may_trace = F.col("text").rlike(r"(?im)Traceback \(most recent call last\):|^\s+at\s+\S")
    split_ = blocks.select("block_id", lines.alias("ls"), tracebacks(F.when(may_trace, lines)).alias("tb"))
    rows = split_.select("block_id", F.posexplode("ls").alias("idx", "line"), "tb", F.size("ls").alias("n"))
    rows = rows.withColumns({"level": level(F.col("line")), "trace": F.coalesce(F.get("tb", F.col("idx")), F.lit(False))})
    important = ((F.col("level") >= 2) | F.col("trace")).cast("int")
    near = F.max(important).over(Window.partitionBy("block_id").orderBy("idx").rowsBetween(-context, context))
    keep = (near == 1) | F.col("trace") | (F.col("idx") == 0) | (F.col("idx") == F.col("n") - 1)
    return rows.select("block_id", "idx", "line", "level", keep.alias("keep"), "n")


def pieces(rows: DataFrame) -> DataFrame:
    """(block_id, idx, piece, original): kept lines, and one marker for each maximal run of dropped ones (gaps and islands)."""
    order = Window.partitionBy("block_id").orderBy("idx")
    island = F.sum(F.col("keep").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_run", F.when(~F.col("keep"), island))
    kept = runs.filter("keep").select("block_id", "idx", F.col("line").alias("piece"), F.lit(None).cast("string").alias("original"))
    gone = runs.filter("not keep").groupBy("block_id", "_run").agg(F.min("idx").alias("idx"), F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("ls"))
    marked = gone.select("block_id", "idx", text_marker(F.col("ls.line"), "lines-elided").alias("piece"), F.array_join("ls.line", "\n").alias("original"))
    return kept.unionByName(marked)


def collapsed(parts: DataFrame) -> DataFrame:
    """parts with repeats of the piece before collapsed to one with `  (xN)`, except in traces and where an id tells lines apart."""
    order = Window.partitionBy("block_id").orderBy("idx")
    s = strip(F.col("piece"))
    tied = F.col("piece").startswith("Traceback (most recent call last):") | s.startswith("at ") | s.startswith("File ") | F.col("piece").rlike(DISTINCT)
    new = F.coalesce((F.col("piece") != F.lag("piece").over(order)) | tied, F.lit(True))
    runs = parts.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("block_id", "_run").agg(F.min("idx").alias("idx"), F.first("piece").alias("piece"), F.count("*").alias("times"))
    return out.select("block_id", "idx", F.when(F.col("times") > 1, F.concat("piece", F.lit("  (x"), F.col("times").cast("string"), F.lit(")"))).otherwise(F.col("piece")).alias("piece"))


def compress(blocks: DataFrame, context: int = 1) -> DataFrame:
    """(block_id, new_text, dropped array<struct<hash, original>>) of blocks (block_id, text); short blocks and those in which all is kept come back as they are."""
    rows = flagged(blocks, context)
    parts = pieces(rows)
    text = collapsed(parts).groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "piece"))), lambda x: x["piece"]), "\n").alias("new_text"))
    dropped = parts.filter("original is not null").groupBy("block_id").agg(F.collect_list(F.struct(content_hash(F.col("original")).alias("hash"), "original")).alias("dropped"))
    none = F.expr("cast(array() as array<struct<hash: string, original: string>>)")
    short = F.size(F.split("text", "\n", -1)) < FEWEST
    out = blocks.select("block_id", "text").join(text, "block_id").join(dropped, "block_id", "left")
    same = short | F.col("dropped").isNull()
    return out.select("block_id", F.when(same, F.col("text")).otherwise(F.col("new_text")).alias("new_text"), F.when(same, none).otherwise(F.col("dropped")).alias("dropped"))
