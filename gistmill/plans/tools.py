"""Small entry points over the pipeline: tool outputs, single texts, images, reports and rule files."""

from __future__ import annotations

import difflib
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images
from . import compress as C

BEGIN, END = "<!-- learned rules: begin -->", "<!-- learned rules: end -->"


def compress_tool_outputs(outputs: DataFrame, c: C.Config | None = None) -> DataFrame:
    """outputs (id, text) with new_text, which is taken only if it is strictly shorter."""
    blocks = outputs.select(F.col("id").cast("string").alias("block_id"), "id", "text", F.lit(None).cast("string").alias("query"))
    done = C.compress_blocks(blocks.filter("text is not null"), c)
    return done.select("id", "text", F.when(F.length("new_text") < F.length("text"), F.col("new_text")).otherwise(F.col("text")).alias("new_text"), "dropped")


def compress_text(spark: SparkSession, text: str, target_ratio: float = 0.2, c: C.Config | None = None) -> str:
    """One text, whatever its size."""
    rows = spark.createDataFrame([("0", text)], "id string, text string")
    return compress_tool_outputs(rows, replace(c or C.Config(), min_bytes=0, target_ratio=target_ratio)).first()["new_text"]


def image_plans(pictures: DataFrame, target: int | None = None) -> DataFrame:
    """pictures (id, provider, data binary, detail) with width, height and plan of PNG, GIF and JPEG data; others null."""
    quick = images.png_gif_size(F.col("data"))
    size = F.coalesce(quick, images.jpeg_size(F.when(F.substring(F.hex(F.substring("data", 1, 2)), 1, 4) == "FFD8", F.col("data"))))
    p = pictures.withColumn("_s", size).withColumns({"width": F.col("_s.width"), "height": F.col("_s.height")}).drop("_s")
    plan = images.plan(F.col("width"), F.col("height"), F.col("provider"), F.lit(target).cast("int"), F.coalesce("detail", F.lit("auto")))
    return p.withColumn("plan", F.when(F.col("width") > 0, plan))


def image_stats(planned: DataFrame) -> DataFrame:
    """(n_images, n_known, n_reduced, tokens_before, tokens_after)."""
    return planned.agg(
        F.count("*").alias("n_images"), F.count("plan").alias("n_known"), F.count_if(F.col("plan.strategy") != "passthrough").alias("n_reduced"),
        F.sum("plan.before").alias("tokens_before"), F.sum("plan.after").alias("tokens_after"),
    )


def report(totals: DataFrame, label: str) -> str:
    """A text table of totals (label, orig_tokens, new_tokens, ratio): a report of few rows."""
    rows = [(str(r[label]), f"{r['orig_tokens']:,}", f"{r['new_tokens']:,}", f"{r['ratio']:.1%}") for r in totals.orderBy(label).collect()]
    rows = [(label, "before", "after", "saved"), *rows]
    widths = [max(len(r[i]) for r in rows) for i in range(4)]
    return "\n".join("  ".join(x.ljust(w) if i == 0 else x.rjust(w) for i, (x, w) in enumerate(zip(r, widths, strict=True))) for r in rows)


def apply_rules(block: str, target: str, dry_run: bool = True) -> str:
    """Puts a rules block between the markers of a file on the driver (at its end where there are none), keeping the file's line
    ends; doing it again changes nothing. Returns the unified diff. ValueError if only one marker is there, or they are
    out of order."""
    old = ""
    if os.path.exists(target):
        with open(target, encoding="utf-8", newline="") as f:
            old = f.read()
    line = "\r\n" if "\r\n" in old else "\n"
    a, b = old.find(BEGIN), old.find(END)
    if (a < 0) != (b < 0) or a > b or old.count(BEGIN) > 1 or old.count(END) > 1:
        raise ValueError(f"{target}: the markers of learned rules are damaged")
    own = line.join([BEGIN, *block.rstrip("\n").split("\n"), END])
    if a >= 0:
        new = old[:a] + own + old[b + len(END) :]
    else:
        new = old + (line if old and not old.endswith("\n") else "") + (line if old else "") + own + line
    if not dry_run and new != old:
        with open(target, "w", encoding="utf-8", newline="") as f:
            f.write(new)
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), target, target))
