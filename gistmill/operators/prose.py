"""Prose: sentences scored by place, length, rarity and the query; the best share stays."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markers import PREFIX
from ..functions.text import STOPWORDS, content_words, sentences, strip

FENCE = "```"


def is_structural(paragraph: Column) -> Column:
    """Blank, a heading, list item, quote, fence, tag or image: kept as it is."""
    return strip(paragraph).rlike(r"^(?:\z|#|[-*+]\s|\d+\.\s|>|```|<|!\[)")


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(block_id, p_idx, text, structural): parts between blank lines; parts from an odd number of fences to the next odd one
    are one structural part (islands of the running parity)."""
    raw = blocks.select("block_id", F.posexplode(F.split("text", "\n\n", -1)).alias("p_idx", "p"))
    odd = F.regexp_count("p", F.lit(FENCE)) % 2
    order = Window.partitionBy("block_id").orderBy("p_idx")
    upto = F.sum(odd).over(order.rowsBetween(Window.unboundedPreceding, 0))
    raw = raw.withColumns({"_odd": odd, "_in": (upto - odd) % 2 == 1})  # _in: a fence was open before this part
    raw = raw.withColumn("_start", F.when(~F.col("_in"), F.col("p_idx")))
    raw = raw.withColumn("_group", F.last("_start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = raw.groupBy("block_id", F.col("_group").alias("p_idx")).agg(F.array_sort(F.collect_list(F.struct("p_idx", "p"))).alias("ps"), F.max("_odd").alias("_fenced"))
    text = F.array_join("ps.p", "\n\n")
    return joined.select("block_id", "p_idx", text.alias("text"), ((F.col("_fenced") == 1) | is_structural(text)).alias("structural"))


def scored(parts: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(block_id, p_idx, s_idx, sentence, score) of the sentences of paragraphs() that aren't structural."""
    prose = parts.filter("not structural").select("block_id", "p_idx", "text")
    freq = prose.select("block_id", F.explode(content_words(F.col("text"))).alias("word")).groupBy("block_id", "word").agg(F.count("*").alias("freq"))
    lines = prose.select("block_id", "p_idx", sentences(F.col("text")).alias("ss"))
    lines = lines.select("block_id", "p_idx", F.size("ss").alias("n"), F.posexplode("ss").alias("s_idx", "sentence")).withColumn("cw", content_words(F.col("sentence")))
    rare = lines.select("block_id", "p_idx", "s_idx", F.explode("cw").alias("word")).join(freq, ["block_id", "word"])
    rare = rare.groupBy("block_id", "p_idx", "s_idx").agg(F.sum(1.5 / (1.0 + F.col("freq"))).alias("rarity"))
    out = lines.join(rare, ["block_id", "p_idx", "s_idx"], "left")
    words = F.size("cw")
    place = F.when(F.col("s_idx") == 0, 3.0).when(F.col("s_idx") == F.col("n") - 1, 1.5).otherwise(0.0)
    score = F.when(words == 0, 0.0).otherwise(1.0 + place + words * 0.01 - F.greatest(words - 30, F.lit(0)) * 0.05 + F.col("rarity") / words)
    if queries is not None:
        out = out.join(queries.select("block_id", F.coalesce(content_words(F.col("query")), F.expr("cast(array() as array<string>)")).alias("qw")), "block_id", "left")
        score = score + 3.0 * F.coalesce(F.size(F.filter("qw", lambda w: F.array_contains("cw", w))), F.lit(0))
    return out.select("block_id", "p_idx", "s_idx", "sentence", score.alias("score"))


def chosen(rows: DataFrame, ratio: float = 0.2) -> DataFrame:
    """rows with keep: the best round(ratio * n) sentences of a block (half to even, 1 at least), ties by place."""
    k = F.greatest(F.lit(1), F.bround(F.count("*").over(Window.partitionBy("block_id")) * F.lit(ratio)))
    place = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc(F.round("score", 9)), "p_idx", "s_idx"))
    return rows.withColumn("keep", place <= k)


_BLANK = r"[ \t\n\x0b\f\r]"  # Java's \\s, as in is_structural()
_STRUCTURAL = re.compile(rf"#|[-*+]{_BLANK}|[0-9]+\.{_BLANK}|>|```|<|!\[")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"(?<!\w)[a-zA-Z0-9]+(?!\w)")
_STOP = frozenset(STOPWORDS)


def _words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if w not in _STOP]


def elided(text: str, query: str | None = None, ratio: float = 0.2) -> tuple[str, list[tuple[str, str]]]:
    """(new text, [(hash, original)]) of one text: what paragraphs(), scored() and chosen() say of it, put together."""
    parts: list[tuple[list[str], bool]] = []  # the pieces of a paragraph, whether a fence opens or closes in it
    open_ = False
    for p in text.split("\n\n"):
        odd = p.count(FENCE) % 2 == 1
        if open_:
            parts[-1][0].append(p)  # it began with a fence
        else:
            parts.append(([p], odd))
        open_ ^= odd
    whole = ["\n\n".join(ps) for ps, _ in parts]
    prose = {i: [x for s in _SENTENCE.split(t) if (x := s.strip())] for i, (t, (_, fenced)) in enumerate(zip(whole, parts, strict=True)) if not (fenced or not (b := t.strip()) or _STRUCTURAL.match(b))}
    words = {(i, k): _words(s) for i, ss in prose.items() for k, s in enumerate(ss)}
    if not words:
        return text, []
    freq = Counter(w for ws in words.values() for w in ws)
    asked = _words(query or "")

    def score(i: int, k: int) -> float:
        ws = words[i, k]
        place = 3.0 if k == 0 else 1.5 if k == len(prose[i]) - 1 else 0.0
        own = 1.0 + place + len(ws) * 0.01 - max(len(ws) - 30, 0) * 0.05 + sum(1.5 / (1.0 + freq[w]) for w in ws) / len(ws) if ws else 0.0
        return own + 3.0 * sum(w in found for w in asked) if asked and (found := set(ws)) else own

    order = sorted(words, key=lambda at: (-round(score(*at), 9), at))
    keep = set(order[: max(1, round(len(words) * ratio))])
    lost = []
    for i, ss in prose.items():
        made = []
        for kept, run in groupby(enumerate(ss), lambda x: (i, x[0]) in keep):
            run = [s for _, s in run]
            if kept:
                made += run
            else:
                original = "\n".join(run)
                lost.append((key := sha256(original.encode()).hexdigest()[:16], original))
                made.append(f"{PREFIX} {len(run)} prose-elided <<ccr:{key} {len(run)} prose-elided>>")
        whole[i] = " ".join(made)
    new = "\n\n".join(whole)
    return (new, lost) if len(new) < len(text) else (text, [])


def compress(blocks: DataFrame, ratio: float = 0.2, queries: DataFrame | Column | None = None) -> DataFrame:
    """(block_id, new_text, dropped): structural parts and the chosen sentences, a marker for each run of dropped ones in a
    paragraph; the block as it is if that isn't shorter or has no sentence. queries: (block_id, query), or a column of blocks.

    Each text is handled for itself by elided(), so nothing is shuffled; a text is the largest unit that one task holds.
    """

    @F.pandas_udf("struct<new_text: string, dropped: array<struct<hash: string, original: string>>>")
    def run(texts: pd.Series, asked: pd.Series) -> pd.DataFrame:
        done = [elided(t, q, ratio) for t, q in zip(texts, asked, strict=True)]
        return pd.DataFrame([(t, [{"hash": h, "original": o} for h, o in lost]) for t, lost in done], columns=["new_text", "dropped"])

    rows = blocks.filter("text is not null")
    if isinstance(queries, DataFrame):
        rows = rows.select("block_id", "text").join(queries.select("block_id", F.col("query").alias("_query")), "block_id", "left")
        queries = F.col("_query")
    asked = F.lit(None) if queries is None else queries
    return rows.select("block_id", run("text", asked.cast("string")).alias("r")).select("block_id", "r.*")
