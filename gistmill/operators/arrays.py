"""What a JSON array of objects or numbers keeps: ends, errors, query matches, rare values, outliers and change points.

Rows are items of arrays: a key names the array, idx (from 0) the place in it. All are windows and aggregates by array, so
arrays of any number are handled at once; an array's rows meet in one task, as its order asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchors, identifiers

#: Hints in names of fields and words that mark an error: fixed values.
ID_HINT = "id|uuid|key|pk|_id|guid"
SCORE_HINT = "score|rank|weight|confidence|prob|rating|distance"
STATUS_HINT = "status|state|level|type|code|result|severity|kind"
ERROR_WORDS = ("error", "fail", "failed", "failure", "exception", "traceback", "fatal", "critical", "panic", "denied", "timeout", "abort")


def keep_ends(items: DataFrame, key: str, head: int = 5, tail: int = 3, idx: str = "idx") -> DataFrame:
    """items with keep_end: the first `head` and last `tail` of each array."""
    n = F.count("*").over(Window.partitionBy(key))
    return items.withColumn("keep_end", (F.col(idx) < head) | (F.col(idx) >= n - tail))


def is_error(json_text: Column) -> Column:
    """Whether an item's text holds an error word."""
    return F.lower(json_text).rlike("|".join(ERROR_WORDS))


def matches_query(json_text: Column, query: Column) -> Column:
    """Whether an item shares an identifier with the query's anchors."""
    return F.arrays_overlap(identifiers(json_text), anchors(query))


def anomalies(items: DataFrame, key: str, value: str, idx: str = "idx", sigmas: float = 2.0, shift: float = 0.15) -> DataFrame:
    """items with outlier (over `sigmas` population deviations from the array's mean) and change (on either side of the
    place where the running sum of squares departs most from a straight line, if by over `shift`; arrays of 4 or more).
    Null values count for nothing.
    """
    by, order = Window.partitionBy(key), Window.partitionBy(key).orderBy(idx)
    v = F.col(value).cast("double")
    out = items.withColumns({"_n": F.count(v).over(by), "_mean": F.avg(v).over(by), "_sd": F.stddev_pop(v).over(by)})
    out = out.withColumns({"_sq": F.pow(v - F.col("_mean"), 2), "_i": F.count(v).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.withColumns({"_c": F.sum("_sq").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("_sq").over(by)})
    d = F.when((F.col("_n") >= 4) & (F.col("_t") > 0) & v.isNotNull() & (F.col("_i") < F.col("_n")), F.abs(F.col("_c") / F.col("_t") - F.col("_i") / F.col("_n")))
    out = out.withColumn("_d", F.round(d, 12))
    # the largest departure, of equal ones the first
    best = F.max(F.when(F.col("_d").isNotNull(), F.struct(F.col("_d").alias("d"), (-F.col("_i")).alias("at")))).over(by)
    out = out.withColumn("_best", best)
    change = (F.col("_best.d") > shift) & v.isNotNull() & ((F.col("_i") == -F.col("_best.at")) | (F.col("_i") == -F.col("_best.at") + 1))
    outlier = (F.col("_sd") > 0) & (F.abs(v - F.col("_mean")) / F.col("_sd") > sigmas)
    out = out.withColumns({"outlier": F.coalesce(outlier, F.lit(False)), "change": F.coalesce(change, F.lit(False)), "change_d": F.col("_best.d")})
    return out.drop("_n", "_mean", "_sd", "_sq", "_i", "_c", "_t", "_d", "_best")


def field_stats(cells: DataFrame, key: str, field: str = "field", value: str = "value", number: str | None = None) -> DataFrame:
    """(key, field, present, cardinality, entropy, is_id, is_score, is_status) from (key, field, value) cells.

    Two levels of aggregation: values are counted first, so a frequent value costs one row. entropy is in bits.
    """
    counted = cells.groupBy(key, field, value).agg(F.count("*").alias("c"), *([F.max(F.col(number).cast("int")).alias("num")] if number else []))
    by = Window.partitionBy(key, field)
    p = F.col("c") / F.sum("c").over(by)
    agg = counted.withColumn("_e", -p * F.log2(p)).groupBy(key, field).agg(
        F.sum("c").alias("present"), F.count("*").alias("cardinality"), F.sum("_e").alias("entropy"), (F.min("num") if number else F.lit(0)).alias("_num")
    )
    named = lambda hint: F.lower(F.col(field)).rlike(f"(?:{hint})$")
    is_id = named(ID_HINT) | ((F.col("cardinality") == F.col("present")) & (F.col("present") > 1))
    low = F.col("cardinality") <= F.greatest(F.lit(2.0), F.col("present") * 0.2)
    return agg.select(
        key, field, "present", "cardinality", "entropy", is_id.alias("is_id"), (named(SCORE_HINT) & (F.col("_num") == 1)).alias("is_score"),
        ((named(STATUS_HINT) | low) & ~is_id).alias("is_status"),
    )


def rare_values(cells: DataFrame, key: str, field: str = "field", value: str = "value", threshold: float = 0.05) -> DataFrame:
    """(key, field, value, c): of status-like fields the values that are at most max(1, threshold * rows) and half the commonest."""
    stats = field_stats(cells, key, field, value).filter("is_status").select(key, field, "present")
    counted = cells.groupBy(key, field, value).agg(F.count("*").alias("c")).withColumn("_mode", F.max("c").over(Window.partitionBy(key, field)))
    rare = (F.col("c") <= F.greatest(F.lit(1), F.floor(F.col("present") * threshold))) & (F.col("c") <= 0.5 * F.col("_mode"))
    return counted.join(stats, [key, field]).filter(rare).select(key, field, value, "c")


def cap_rare(items: DataFrame, key: str, flag: str, idx: str = "idx", cap: int = 5) -> DataFrame:
    """items with keep_rare: the first `cap` rows of each array whose flag is set."""
    rank = F.row_number().over(Window.partitionBy(key, flag).orderBy(idx))
    return items.withColumn("keep_rare", F.col(flag) & (rank <= cap))
