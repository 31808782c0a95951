"""Functions that need a Python library: model tokenizers, embeddings, likeness of answers. All work on Arrow batches."""

from __future__ import annotations

import base64
import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What splits text before byte pairs merge, for vocabularies of that kind: a fixed value.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def model_token_count(ranks_path: str, pattern: str = SPLIT) -> Callable[[Column], Column]:
    """A column function that counts tokens under a vocabulary of byte-pair ranks; the file is read on the driver."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(enc.encode_ordinary(t)))

    return count


def embedded(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text") -> DataFrame:
    """texts with embedding: `load` makes a model once a task, which maps a batch of texts to vectors."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model([t or "" for t in b]))

    return texts.withColumn("embedding", embed(text))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching characters of two answers, 1 for equal ones; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
