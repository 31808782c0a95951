"""Search results: `path:line:content` dumps parsed, scored and ranked by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markers import PREFIX, marker
from ..functions.text import content_hash, identifiers, strip

#: The hit line and what marks a definition: fixed values.
HIT = r"(?s)^((?:[A-Za-z]:[\\/])?.*?)([:-])(\d+)\2(.*)$"
DEFINITION = r"\b(?:def|class|function|func|fn|interface|struct|impl|type|const|let|var)\b|=\s|=>|:=|public|private|export"


def parts(line: Column) -> Column:
    """array<path, sign, line number, content> of a hit; an array of one for any other line. The pattern is searched once;
    only lines that hold a NUL, which stands between the parts, search it for each part."""
    each = F.array(*[F.regexp_extract(line, HIT, g) for g in (1, 2, 3, 4)])
    once = F.split(F.regexp_replace(line, HIT, "$1\0$2\0$3\0$4"), "\0", 4)
    return F.when(~F.contains(line, F.lit("\0")), once).when(line.rlike(HIT), each).otherwise(F.array(line))


def score(h: Column) -> Column:
    """1 for a match and 0.3 for context, 1 more for a definition, 0.3 less for a line of over 200 characters."""
    s = F.when(h["is_match"], 1.0).otherwise(0.3) + F.when(h["content"].rlike(DEFINITION), 1.0).otherwise(0.0)
    return s - F.when(F.length(h["content"]) > 200, 0.3).otherwise(0.0)


def hits(blocks: DataFrame) -> DataFrame:
    """(block_id, idx, path, lineno, content, is_match, score) of blocks (block_id, text)."""
    rows = blocks.select("block_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line")).filter(strip(F.col("line")) != "")
    rows = rows.select("block_id", "idx", parts(F.col("line")).alias("p")).filter((F.size("p") == 4) & (F.get("p", F.lit(0)) != ""))
    part = lambda i: F.get("p", F.lit(i))
    h = F.struct(part(0).alias("path"), part(2).cast("long").alias("lineno"), part(3).alias("content"), (part(1) == ":").alias("is_match"))
    return rows.select("block_id", "idx", h.alias("h")).select("block_id", "idx", "h.*", score(F.col("h")).alias("score"))


def ranked(found: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(block_id, path, first, n_hits, score, rank): files by score, ties by first appearance; with queries (block_id, query)
    3 times the BM25 of a file's hits among its block's files is added."""
    files = found.groupBy("block_id", "path").agg(F.min("idx").alias("first"), F.count("*").alias("n_hits"), F.sum("score").alias("score"))
    if queries is not None:
        words = found.join(queries, "block_id").select("block_id", "path", "query", F.explode_outer(identifiers(F.col("content"))).alias("term"))
        asked = F.array_contains(F.array_distinct(identifiers(F.col("query"))), F.col("term"))
        lengths = words.groupBy("block_id", "path").agg(F.count("term").alias("dl"))
        mean = lengths.withColumns({"n": F.count("*").over(Window.partitionBy("block_id")), "mean": F.avg("dl").over(Window.partitionBy("block_id"))})
        tf = words.filter(asked).groupBy("block_id", "path", "term").agg(F.count("*").alias("tf"))
        tf = tf.withColumn("df", F.count("*").over(Window.partitionBy("block_id", "term"))).join(mean, ["block_id", "path"])
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("mean")))
        bonus = tf.groupBy("block_id", "path").agg(F.sum(part).alias("bm25"))
        files = files.join(bonus, ["block_id", "path"], "left").withColumn("score", F.col("score") + 3.0 * F.coalesce("bm25", F.lit(0.0))).drop("bm25")
    # scores are rounded so that equal sums tie whatever the order of their parts
    order = Window.partitionBy("block_id").orderBy(F.desc(F.round("score", 9)), "first")
    return files.withColumn("rank", F.row_number().over(order))


def compress(blocks: DataFrame, max_files: int = 20, queries: DataFrame | None = None) -> DataFrame:
    """(block_id, new_text, dropped): hits grouped under their paths, the best files in their order, a marker for the rest;
    the block as it is if that isn't shorter or nothing parses."""
    found = hits(blocks)
    order = ranked(found, queries)
    rows = found.join(order.select("block_id", "path", "first", "rank"), ["block_id", "path"])
    sign = F.when(F.col("is_match"), ":").otherwise("-")
    line = F.concat(F.lit("  "), F.col("lineno").cast("string"), sign, F.lit(" "), F.col("content"))
    plain = F.concat(F.col("path"), F.lit(":"), F.col("lineno").cast("string"), sign, F.col("content"))
    files = rows.groupBy("block_id", "path", "first", "rank").agg(
        F.array_sort(F.collect_list(F.struct("idx", line.alias("line"), plain.alias("plain")))).alias("hs"), F.count("*").alias("n")
    )
    shown = F.concat("path", F.lit(":\n"), F.array_join("hs.line", "\n"))
    packed = files.groupBy("block_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") <= max_files, F.struct("first", shown.alias("t"))))).alias("kept"),
        F.array_sort(F.collect_list(F.when(F.col("rank") > max_files, F.struct("rank", "n", F.array_join("hs.plain", "\n").alias("t"))))).alias("gone"),
    )
    n_hits = F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    original = F.array_join("gone.t", "\n")
    key = content_hash(original)
    tail = F.concat(F.lit("\n" + PREFIX + " "), F.size("gone").cast("string"), F.lit(" files / "), n_hits.cast("string"), F.lit(" hits elided (low relevance) "), marker(key, n_hits, "files-elided"))
    some = F.size("gone") > 0
    text = F.concat(F.array_join("kept.t", "\n"), F.when(some, tail).otherwise(""))
    none = F.expr("cast(array() as array<struct<hash: string, original: string>>)")
    out = blocks.select("block_id", "text").join(packed.select("block_id", text.alias("t"), F.when(some, F.array(F.struct(key.alias("hash"), original.alias("original")))).otherwise(none).alias("d")), "block_id", "left")
    better = F.coalesce(F.length("t") < F.length("text"), F.lit(False))
    return out.select("block_id", F.when(better, F.col("t")).otherwise(F.col("text")).alias("new_text"), F.when(better, F.col("d")).otherwise(none).alias("dropped"))
