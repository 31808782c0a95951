"""Removal of repeated line runs by a suffix array over line ids, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns_of, keyed, merged, whole_text


def _ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, first) of the prefixes that two suffixes or more begin with.

    Ranks ascend in the order of the keys, so they sort suffixes: keys are range-partitioned, sorted, and numbered by
    partition and row. Only prefixes found twice are kept (a suffix whose prefix is unique is in its final place), so
    each round sorts one row for each repeated prefix. Equal prefixes are counted on the map side first.
    """
    repeated = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("_did", "_sub", "line")).alias("first")).filter("n > 1").drop("n")
    return repeated.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id())


def suffix_levels(distinct: DataFrame, scratch: Scratch, longest: int) -> list[DataFrame]:
    """Level k: (_did, _sub, line, rank, bytes, late) of the suffixes whose first 2**k (up to longest) lines occur elsewhere too.

    Suffixes with one rank form an interval of the suffix array with a common prefix of 2**k lines at least; late is
    false for the interval's first suffix in the order of (doc_id, line) and true for its later copies. Prefix doubling:
    a prefix of 2**(k+1) lines is the pair of ranks at its start and 2**k lines on. Prefixes end with their document.
    """
    line_hash = [F.xxhash64("l").alias("h1"), F.xxhash64(F.lit(1), "l").alias("h2")]  # 128 bits stand for a line
    at = F.posexplode(F.split("_text", "\n")).alias("line", "l")
    pairs = distinct.select("_did", "_sub", at).select("_did", "_sub", "line", *line_hash, F.octet_length("l").cast("long").alias("bytes"))
    keys, levels = ["h1", "h2"], []
    while True:
        names = scratch.save(_ranked(pairs, keys), "ranks")
        late = F.struct("_did", "_sub", "line") > F.col("first")
        level = scratch.save(pairs.join(names, keys).select("_did", "_sub", "line", "rank", "bytes", late.alias("late")), "level")
        scratch.drop(names)
        if level.limit(1).count() == 0:
            return levels
        step = 2 ** len(levels)
        levels.append(level)
        if 2 * step > longest:
            return levels
        ahead = Window.partitionBy("_did", "_sub").orderBy("line").rangeBetween(step, step)
        pairs = level.select(
            "_did", "_sub", "line", F.col("rank").alias("r1"), F.max("rank").over(ahead).alias("r2"), (F.col("bytes") + 1 + F.max("bytes").over(ahead)).alias("bytes")
        ).filter("r2 is not null")
        keys = ["r1", "r2"]


def least_runs(lines: DataFrame, min_bytes: int) -> DataFrame:
    """(_did, _sub, s, e): of the repeated lines, the shortest runs of min_bytes or more from each line on and up to each line."""
    place = ["_did", "_sub", "island"]
    row = F.row_number().over(Window.partitionBy("_did", "_sub").orderBy("line"))
    rows = lines.select("_did", "_sub", "line", "bytes").withColumn("island", F.col("line") - row)  # lines that follow on each other
    rows = rows.withColumn("stop", F.sum(F.col("bytes") + 1).over(Window.partitionBy(*place).orderBy("line"))).withColumn("begin", F.col("stop") - F.col("bytes") - 1)
    on = Window.partitionBy(*place).orderBy("begin").rangeBetween(0, min_bytes)
    upto = Window.partitionBy(*place).orderBy("stop").rangeBetween(-min_bytes, 0)
    rows = rows.select("_did", "_sub", "line", "begin", "stop", F.max("line").over(on).alias("last"), F.max("stop").over(on).alias("last_stop"), F.min("line").over(upto).alias("first"), F.min("begin").over(upto).alias("first_begin"))
    ways = [
        F.when(F.col("last_stop") - F.col("begin") - 1 >= min_bytes, F.struct(F.col("line").alias("s"), F.col("last").alias("e"))),
        F.when(F.col("stop") - F.col("first_begin") - 1 >= min_bytes, F.struct(F.col("first").alias("s"), F.col("line").alias("e"))),
    ]
    runs = rows.select("_did", "_sub", F.explode(F.array_distinct(F.array_compact(F.array(*ways)))).alias("r"))
    return runs.select("_did", "_sub", F.col("r.s").alias("s"), (F.col("r.e") + 1).alias("e")).distinct()


def late_runs(distinct: DataFrame, min_bytes: int, scratch: Scratch) -> DataFrame:
    """(_did, _sub, runs): the line ranges to remove from each document that has any, sorted and disjoint.

    These are the lines of all runs of min_bytes or more, of any number of lines, that also start earlier. A part of such
    a run starts earlier too, so each of its lines lies in a part of it that is the shortest one of min_bytes from its
    first line on or up to its last (from the line on, else up to the line, else from the run's start on). Only these
    shortest runs need names. They have min_bytes + 1 lines at most; the name of a run of m lines is m and the ranks of the
    2**k lines (2**k <= m < 2**(k+1)) at its start and at its end. Equal runs are the shortest at each of their places.
    """
    levels = suffix_levels(distinct, scratch, min_bytes + 1)
    if not levels:
        return distinct.limit(0).select("_did", "_sub", F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)").alias("runs"))
    ranks = None
    for k, level in enumerate(levels):
        part = level.select("_did", "_sub", F.lit(k).alias("k"), F.col("line").alias("at"), "rank")
        ranks = part if ranks is None else ranks.unionByName(part)
    m = F.col("e") - F.col("s")
    k = sum((m >= 2**j).cast("int") for j in range(1, (min_bytes + 1).bit_length())) + F.lit(0)
    runs = scratch.save(least_runs(levels[0], min_bytes).withColumns({"m": m, "k": k}), "runs")
    half = F.expr("cast(shiftleft(1, k) as int)")
    named = (
        runs.join(ranks.withColumnsRenamed({"at": "s", "rank": "r1"}), ["_did", "_sub", "k", "s"])
        .withColumn("t", F.col("e") - half)
        .join(ranks.withColumnsRenamed({"at": "t", "rank": "r2"}), ["_did", "_sub", "k", "t"])
    )
    named = scratch.save(named.select("_did", "_sub", "s", "e", "m", "r1", "r2"), "named")
    for x in (*levels, runs):
        scratch.drop(x)
    at = F.struct("_did", "_sub", "s")
    first = named.groupBy("m", "r1", "r2").agg(F.count("*").alias("n"), F.min(at).alias("first")).filter("n > 1").drop("n")
    late = named.join(first, ["m", "r1", "r2"]).filter(at > F.col("first"))
    r = F.struct(F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    out = scratch.save(late.groupBy("_did", "_sub").agg(merged(F.collect_list(r)).alias("runs")), "late")
    scratch.drop(named)
    return out


def dedup_lines(docs: DataFrame, min_bytes: int = 40, scratch: Scratch | None = None) -> DataFrame:
    """docs with later copies of repeated line runs taken out of text, and n_lines, n_removed and n_runs added.

    A line is removed if it lies in a run of consecutive lines, of any number, of its document that holds min_bytes
    UTF-8 bytes or more (newlines between them included) and that also starts earlier: in a document with a smaller
    doc_id, or earlier in the same one. So maximal repeated runs of min_bytes go as a whole; first copies stay. n_runs
    counts the maximal removed runs.
    Lines are split at \\n alone and compared byte by byte (as 128-bit hashes). A null text has no lines and stays null;
    an empty one has one empty line. Rows with a null doc_id come before all others. Rows that repeat a doc_id and text
    are one document and get the same result; other rows with one doc_id are separate documents in the order of their
    texts. An empty table gives no rows. Columns of docs stay, but for those named like the added ones.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed", "n_runs")
    rows, distinct = keyed(docs)
    runs = late_runs(distinct, min_bytes, scratch)
    text = F.col("row.text")
    lines = F.split(whole_text(text), "\n")
    kept = F.filter(lines, lambda _, i: ~F.exists("runs", lambda r: (i >= r["s"]) & (i < r["e"])))
    left = F.when(text.isNull() | F.col("runs").isNull(), text).otherwise(F.concat_ws("\n", kept))
    removed = F.coalesce(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"]), F.lit(0).cast("long"))
    return rows.join(runs.hint("shuffle_hash"), ["_did", "_sub"], "left").select(
        *columns_of(docs, text=left),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        removed.alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
    )


#: DuckDB SQL for op2, from the definition: equal lines of two documents on one diagonal form their common runs.
ORACLE = """with l as materialized (select doc_id, u.line, u.l, strlen(u.l) as b
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) d, unnest(ls) with ordinality as u(l, line)),
same as (select a.doc_id, a.line, a.b, e.doc_id as doc2, a.line - e.line as diagonal
  from l a join l e on a.l = e.l and (e.doc_id < a.doc_id or (e.doc_id = a.doc_id and e.line < a.line))),
islands as (select *, line - row_number() over (partition by doc_id, doc2, diagonal order by line) as island from same),
runs as (select doc_id, min(line) as s, max(line) as e from islands group by doc_id, doc2, diagonal, island having sum(b) + count(*) - 1 >= 40),
gone as (select distinct doc_id, unnest(range(s, e + 1)) as line from (select distinct doc_id, s, e from runs)),
marked as (select l.*, g.line is not null as out, coalesce(lag(g.line is not null) over (partition by l.doc_id order by l.line), false) as before
  from l left join gone g on l.doc_id = g.doc_id and l.line = g.line),
counts as (select doc_id, count(*) as n, count(*) filter (where out) as n_removed, count(*) filter (where out and not before) as n_runs,
  sha256(coalesce(string_agg(l, chr(10) order by line) filter (where not out), '')) as kept_sha256 from marked group by doc_id)
select c.doc_id, case when d.text is null then 0 else n end as n_lines, n_removed, n_runs, kept_sha256 from counts c join documents d using (doc_id)"""
