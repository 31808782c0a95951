"""Unified diffs: files and hunks numbered by running sums, ranked by churn, context trimmed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markers import PREFIX, marker
from ..functions.text import content_hash, optimal_k

#: Headers: fixed values.
FILE, HUNK = r"^diff --git ", r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"


def parsed(blocks: DataFrame) -> DataFrame:
    """(block_id, idx, line, file_no, hunk_no, is_header): hunk_no is 0 in a file's head, else counts its hunks from 1."""
    rows = blocks.select("block_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))
    order = Window.partitionBy("block_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    is_file = F.col("line").rlike(FILE)
    rows = rows.withColumn("_f", F.sum(is_file.cast("int")).over(order)).withColumn("_head", F.col("line").rlike(HUNK))
    # lines before the first file header are a file of their own
    own = F.max(F.when(F.col("_f") == 0, 1).otherwise(0)).over(Window.partitionBy("block_id"))
    rows = rows.withColumn("file_no", F.col("_f") + own - 1)
    in_file = Window.partitionBy("block_id", "file_no").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("hunk_no", F.sum(F.col("_head").cast("int")).over(in_file)).select("block_id", "idx", "line", "file_no", "hunk_no", F.col("_head").alias("is_header"))


def hunks(rows: DataFrame) -> DataFrame:
    """(block_id, file_no, hunk_no, churn, n_hunks, file_churn): churn counts lines that begin with + or -."""
    changed = F.substring("line", 1, 1).isin("+", "-") & ~F.col("is_header")
    out = rows.filter("hunk_no > 0").groupBy("block_id", "file_no", "hunk_no").agg(F.count_if(changed).alias("churn"))
    by = Window.partitionBy("block_id", "file_no")
    return out.withColumns({"n_hunks": F.count("*").over(by), "file_churn": F.sum("churn").over(by)})


def kept_files(rows: DataFrame, max_files: int = 10) -> DataFrame:
    """(block_id, file_no, churn, keep): the files with most churn, ties by their order."""
    files = rows.groupBy("block_id", "file_no").agg(F.count_if((F.col("hunk_no") > 0) & ~F.col("is_header") & F.substring("line", 1, 1).isin("+", "-")).alias("churn"))
    return files.withColumn("keep", F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("churn"), "file_no")) <= max_files)


def kept_hunks(found: DataFrame, max_hunks: int = 4, ratio: float = 0.2) -> DataFrame:
    """found with keep: a file's first and last hunk, then those with most churn, up to max_hunks (more for very many hunks)."""
    cap = F.greatest(F.lit(max_hunks), optimal_k(F.col("n_hunks"), ratio))
    end = F.when((F.col("hunk_no") == 1) | (F.col("hunk_no") == F.col("n_hunks")), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("block_id", "file_no").orderBy(end, F.desc("churn"), "hunk_no"))
    return found.withColumn("keep", (F.col("n_hunks") <= cap) | (place <= cap))


def trimmed(rows: DataFrame, context: int = 2) -> DataFrame:
    """rows with keep_line: of the context lines at a hunk's ends only `context` on each side stay."""
    by = Window.partitionBy("block_id", "file_no", "hunk_no")
    core = F.when((F.col("hunk_no") > 0) & ~F.col("is_header") & (F.substring("line", 1, 1) != " "), F.col("idx"))
    first, last, end = F.min(core).over(by), F.max(core).over(by), F.max("idx").over(by)
    # a hunk of context alone keeps the last `context` lines
    inside = F.when(first.isNull(), F.col("idx") > end - context).otherwise((F.col("idx") >= first - context) & (F.col("idx") <= last + context))
    return rows.withColumn("keep_line", (F.col("hunk_no") == 0) | F.col("is_header") | inside)


def compress(blocks: DataFrame, max_files: int = 10, max_hunks: int = 4, context: int = 2, ratio: float = 0.2) -> DataFrame:
    """(block_id, new_text, dropped): the block as it is unless that leaves under 0.8 of its characters."""
    rows = parsed(blocks)
    found = hunks(rows)
    plan = trimmed(rows, context)
    plan = plan.join(kept_files(rows, max_files).select("block_id", "file_no", F.col("keep").alias("kf")), ["block_id", "file_no"])
    plan = plan.join(kept_hunks(found, max_hunks, ratio).select("block_id", "file_no", "hunk_no", F.col("keep").alias("kh")), ["block_id", "file_no", "hunk_no"], "left")
    stays = F.col("kf") & F.coalesce("kh", F.lit(True))
    # a dropped file is one chunk, after the dropped hunks of kept files
    chunk = F.when(~F.col("kf"), F.struct(F.lit(1).alias("late"), "file_no", F.lit(0).cast("long").alias("hunk_no"))).when(~F.col("kh"), F.struct(F.lit(0).alias("late"), "file_no", F.col("hunk_no").cast("long").alias("hunk_no")))
    plan = plan.withColumns({"stays": stays, "chunk": chunk})
    item = F.struct("idx", "line")
    lost = plan.filter("chunk is not null").groupBy("block_id", "chunk").agg(F.array_sort(F.collect_list(item)).alias("ls"))
    lost = lost.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("chunk", F.array_join("ls.line", "\n").alias("t")))).alias("chunks"))
    kept = plan.filter("stays and keep_line").groupBy("block_id").agg(F.array_sort(F.collect_list(item)).alias("ls"), F.max((F.col("hunk_no") > 0).cast("int")).alias("any"))
    original = F.array_join("chunks.t", "\n")
    key, n = content_hash(original), F.size("chunks")
    some = F.col("chunks").isNotNull()
    tail = F.concat(F.lit("\n" + PREFIX + " "), n.cast("string"), F.lit(" diff chunks elided "), marker(key, n, "diff-elided"))
    none = F.expr("cast(array() as array<struct<hash: string, original: string>>)")
    out = blocks.select("block_id", "text").join(kept, "block_id").join(lost, "block_id", "left")
    out = out.select("block_id", "text", "any", F.concat(F.array_join("ls.line", "\n"), F.when(some, tail).otherwise("")).alias("t"), F.when(some, F.array(F.struct(key.alias("hash"), original.alias("original")))).otherwise(none).alias("d"))
    better = (F.col("any") == 1) & (F.length("t") < 0.8 * F.length("text"))
    return out.select("block_id", F.when(better, F.col("t")).otherwise(F.col("text")).alias("new_text"), F.when(better, F.col("d")).otherwise(none).alias("dropped"))
