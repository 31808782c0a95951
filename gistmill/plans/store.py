"""Tables of originals, memories and cached answers, in batch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guard
from ..functions.text import content_hash, content_words, jaccard, strip
from ..operators.relevance import bm25, dot, nearest, top


def put(table: DataFrame | None, originals: DataFrame) -> DataFrame:
    """(hash, original, created_at): an upsert by content. Putting again refreshes created_at to the latest."""
    new = originals.select(content_hash(F.col("original")).alias("hash"), "original", "created_at")
    rows = new if table is None else table.select("hash", "original", "created_at").unionByName(new)
    return rows.groupBy("hash").agg(F.first("original").alias("original"), F.max("created_at").alias("created_at"))


def live(table: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Rows that haven't outlived their time (they die after more than ttl_seconds)."""
    return table.filter((now.cast("timestamp").cast("double") - F.col("created_at").cast("timestamp").cast("double")) <= ttl_seconds)


def retrieve(wanted: DataFrame, table: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """wanted (hash, others) with original, null where the table has none. With tracked (hash), hashes not in it are refused."""
    if tracked is not None:
        wanted = wanted.join(tracked.select("hash").distinct(), "hash", "left_semi")
    return wanted.join(table.select("hash", "original"), "hash", "left")


def missing(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of wanted (hash, others) that the table has no original for."""
    return wanted.join(table.select("hash"), "hash", "left_anti")


def search_memory(queries: DataFrame, memory: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank): the k best memories for each query by cosine if both have vectors, else by BM25."""
    if "embedding" in queries.columns:
        out = nearest(queries, memory.select(F.col("id").alias("vec_id"), "embedding"), k)
        return out.select("query_id", F.col("vec_id").alias("id"), F.col("similarity").alias("score"), "rank")
    scored = bm25(queries, memory.select(F.col("id").alias("doc_id"), F.col("content").alias("text")))
    return top(scored, "query_id", k, F.desc(F.round("score", 9)), F.asc("doc_id")).select("query_id", F.col("doc_id").alias("id"), "score", "rank")




def cache_lookup(probes: DataFrame, entries: DataFrame, threshold: float = 0.96, others: bool = False, guarded: bool = True) -> DataFrame:
    """(probe_id, entry_id, response, similarity): for each probe (probe_id, prompt, embedding) the answer of an entry (entry_id,
    prompt, response, embedding, last_used) that may be served; probes without one are left out.

    An equal prompt answers at once (similarity 1): an equi-join by hash. The rest are compared by cosine with all entries in
    blocks of the probes, a stated query set; only pairs at the threshold meet the lexical guard, which guarded=False leaves out
    (an answer to a prompt that is alike but means another thing is then served). The most similar one is
    served, of equal ones the one used last. With others, probes are entries themselves, and the entry with a probe's own id
    doesn't answer it.
    """
    p = probes.withColumn("_k", F.sha2("prompt", 256))
    e = entries.withColumn("_k", F.sha2("prompt", 256))
    order = [F.desc("last_used"), F.desc("entry_id")]
    # of equal prompts the one used last, and with others the one before, for the probe that is the last itself
    latest = e.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter(F.col("_n") <= (2 if others else 1))
    equal = p.select("probe_id", "_k").join(latest.select("_k", "entry_id", "response", "last_used"), "_k")
    if others:
        equal = top(equal.filter("probe_id != entry_id"), "probe_id", 1, *order)
    exact = equal.select("probe_id", "entry_id", "response", F.lit(1.0).alias("similarity"))
    rest = p.join(exact.select("probe_id"), "probe_id", "left_anti") if others else p.join(latest.select("_k"), "_k", "left_anti")
    # what the guard and the cosine need of one side is computed once a row, and prompts don't meet
    rest = rest.select("probe_id", guard.features(F.col("prompt")).alias("pf"), F.col("embedding").cast("array<double>").alias("pe"))
    rest = rest.withColumn("pn", F.sqrt(dot(F.col("pe"), F.col("pe")))).filter("pn > 0 and not isnan(pn)")
    n = rest.count()
    blocks = max(1, math.ceil(n / 10_000))
    own = e.select("entry_id", guard.features(F.col("prompt")).alias("ef"), "response", F.col("embedding").cast("array<double>").alias("ee"), "last_used")
    own = own.withColumn("en", F.sqrt(dot(F.col("ee"), F.col("ee")))).filter("en > 0 and not isnan(en)")
    out = exact
    for i in range(blocks):
        part = rest.filter(F.pmod(F.xxhash64("probe_id"), F.lit(blocks)) == i) if blocks > 1 else rest
        pairs = own.crossJoin(F.broadcast(part)).withColumn("similarity", dot(F.col("pe"), F.col("ee")) / (F.col("pn") * F.col("en"))).filter(F.col("similarity") >= threshold)
        pairs = pairs.filter("probe_id != entry_id") if others else pairs
        good = pairs.filter(guard.safe_features(F.col("pf"), F.col("ef"))) if guarded else pairs
        out = out.unionByName(top(good, "probe_id", 1, F.desc("similarity"), *order).select("probe_id", "entry_id", "response", "similarity"))
    return out


def touched(entries: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """entries with last_used = now for those that hits (entry_id, as cache_lookup() returns them) were served from."""
    served = hits.select("entry_id").distinct().withColumn("_hit", F.lit(True))
    out = entries.join(served, "entry_id", "left").withColumn("last_used", F.when(F.col("_hit"), now.cast(entries.schema["last_used"].dataType)).otherwise(F.col("last_used")))
    return out.select(*entries.columns)


def cache_put(entries: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """The entries (entry_id, prompt, response, embedding, last_used) after those of new are put in, the `most` used last.

    A prompt that is there already, by its hash and text, keeps its entry_id and embedding and takes the response and the
    time of its last put; others come in if their vector can be compared (not null, finite, not all zero). Of one prompt put
    several times the last put counts, of equal times that with the largest entry_id.
    """
    cols = ["entry_id", "prompt", "response", "embedding", "last_used"]
    e = F.col("embedding").cast("array<double>")
    norm = dot(e, e)
    usable = F.coalesce((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.lit(False))
    both = entries.select(*cols, F.lit(0).alias("_new")).unionByName(new.select(*cols, F.lit(1).alias("_new")))
    first = F.min(F.when((F.col("_new") == 0) | usable, F.struct("_new", "last_used", "entry_id", "embedding")))
    last = F.max(F.struct("last_used", "_new", "entry_id", "response"))
    done = both.groupBy(F.sha2("prompt", 256).alias("_k"), "prompt").agg(first.alias("f"), last.alias("l")).filter("f is not null")
    out = done.select("f.entry_id", "prompt", "l.response", "f.embedding", "l.last_used")
    return evict(out, most).select(*cols)


def evict(entries: DataFrame, most: int) -> DataFrame:
    """The `most` entries used last, by a global top-k."""
    return entries.orderBy(F.desc("last_used"), F.desc("entry_id")).limit(most)


def fold_context(facts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(ctx_id, items array<string>): the facts (ctx_id, seq, item) of each context folded in order.

    A fact that shares `threshold` of its words or more with a kept one is dropped, or takes its place if it is longer. The
    fold needs a context's facts in order in one row; contexts are independent.
    """
    clean = facts.select("ctx_id", "seq", strip(F.col("item")).alias("item")).filter("item != ''")
    words = F.array_distinct(content_words(F.col("item")))
    rows = clean.select("ctx_id", F.struct("seq", "item", words.alias("w")).alias("f")).groupBy("ctx_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    empty = F.expr("cast(array() as array<struct<item: string, w: array<string>>>)")

    def add(kept, f):
        like = lambda k: jaccard(f["w"], k["w"]) >= threshold
        made = F.struct(f["item"].alias("item"), f["w"].alias("w"))
        first = F.get(F.filter(kept, like), F.lit(0))
        longer = F.transform(kept, lambda k: F.when((k["item"] == first["item"]) & (F.length(f["item"]) > F.length(k["item"])), made).otherwise(k))
        return F.when(F.exists(kept, like), longer).otherwise(F.concat(kept, F.array(made)))

    return rows.select("ctx_id", F.transform(F.aggregate("fs", empty, add), lambda x: x["item"]).alias("items"))
