"""Ranking by words and by vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score > 0): Okapi BM25 of docs (doc_id, text) for queries (query_id, text).

    Terms meet by an equi-join, so only pairs that share a term are made. Document frequencies and the mean length are
    aggregates; a frequent term's rows are split by adaptive execution. Pairs without a shared term score 0 and are left out.
    """
    words = docs.select("doc_id", identifiers(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    corpus = words.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    terms = queries.select("query_id", F.explode(F.array_distinct(identifiers(F.col("text")))).alias("term"))
    asked = terms.select("term").distinct()  # words that no query asks for go before they are counted and shuffled
    tf = words.select("doc_id", "dl", F.explode("w").alias("term")).join(asked, "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    found = tf.join(terms, "term").join(df, "term").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)))
    return found.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The k first rows of each key. Spark keeps k rows a key and task before the shuffle (WindowGroupLimit)."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero or non-finite vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((n > 0) & ~F.isnan(n), dot(a, b) / n)


#: Most query vectors that are broadcast (64 doubles each: 5 MB).
QUERIES = 10_000


def nearest(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar corpus vectors (vec_id, embedding) for each query (query_id, embedding).

    A stated query set against all vectors. Norms are taken once a vector; queries are broadcast in blocks of QUERIES at
    most, and each task keeps k rows a query before the shuffle.
    """
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("qe")).filter(dot(F.col("qe"), F.col("qe")) > 0)
    c = corpus.select("vec_id", F.col("embedding").cast("array<double>").alias("ce")).withColumn("cn", F.sqrt(dot(F.col("ce"), F.col("ce")))).filter("cn > 0")
    q = q.withColumn("qn", F.sqrt(dot(F.col("qe"), F.col("qe"))))
    n = q.count()
    blocks = max(1, -(-n // QUERIES))
    parts = []
    for i in range(blocks):
        own = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else q
        pairs = c.crossJoin(F.broadcast(own)).select("query_id", "vec_id", (dot(F.col("qe"), F.col("ce")) / (F.col("qn") * F.col("cn"))).alias("similarity"))
        parts.append(top(pairs, "query_id", k, F.desc("similarity"), F.asc("vec_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
