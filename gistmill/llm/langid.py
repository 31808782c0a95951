"""Language identification by n-gram filters that hold one bit a language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-gram lengths in code points, slots of a filter (a power of two), hash functions, languages in a word of its masks.
LENGTHS, SLOTS, HASHES, WORD = (2, 3, 4), 1 << 18, 2, 64
#: Labelled documents a language to learn from, about, and the share of them that an n-gram must occur in.
SAMPLE, COMMON = 4000, 0.04
#: Code points of a text hashed at a time.
CHUNK = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")


def ngram_hashes(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the text's n-grams, of CHUNK starts at a time. What isn't a letter counts as a space, letters as lower case."""
    whole, longest = f" {text.lower()} ", LENGTHS[-1]
    for at in range(0, len(whole), CHUNK):
        c = np.frombuffer(whole[at : at + CHUNK + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        c = np.where((c < 65) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 192)), np.uint64(32), c)
        roll, out = c * np.uint64(0x9E3779B97F4A7C15), []
        for n in range(2, longest + 1):
            if len(c) < n:
                break
            roll = (roll[:-1] ^ (roll[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :] * np.uint64(0x94D049BB133111EB)
            if n in LENGTHS:
                blank = (c[: len(roll)] == 32) & (c[n - 1 :] == 32) if n == 2 else (c[1 : len(roll) + 1] == 32) & (c[n - 2 : len(c) - 1] == 32)
                out.append(roll[:CHUNK][~blank[:CHUNK]])
        if out:
            h = np.concatenate(out)
            h ^= h >> np.uint64(31)
            yield h * np.uint64(0xD6E8FEB86659FD93)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    bits = SLOTS.bit_length() - 1
    return [((h >> np.uint64(k * bits)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """Bit-sliced Bloom filters: slot s holds masks of the languages that have set it, a 64-bit word for each 64 languages.

    priors: how often each language occurs among the labelled rows; the most frequent one (ties: the first by name) is
    the answer for a text with letters of which no n-gram is known. The size is fixed (2 MB for each word).
    """

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray], priors: dict[str, int] | None = None):
        self.languages, self.mask = languages, np.zeros((-(-len(languages) // WORD), SLOTS), np.uint64)
        for k, lang in enumerate(languages):
            for s in _slots(np.asarray(grams[lang], np.uint64)):
                self.mask[k // WORD, np.unique(s)] |= np.uint64(1 << k % WORD)
        full = np.array([((self.mask[k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean() for k in range(len(languages))])
        self.false = full**HASHES  # the chance that a language has an n-gram that it was never given
        self.priors = priors or dict.fromkeys(languages, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the largest corrected share of n-grams, and its part of all corrected shares."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        hits, total = np.zeros(len(self.languages)), 0
        for h in ngram_hashes(text):
            first, second = _slots(h)
            for w, word in enumerate(self.mask):
                both = word[first] & word[second]
                at = range(w * WORD, min((w + 1) * WORD, len(self.languages)))
                hits[at.start : at.stop] += [np.count_nonzero(both & np.uint64(1 << k - at.start)) for k in at]
            total += len(h)
        share = np.clip((hits / max(total, 1) - self.false) / (1 - self.false), 0, None)
        if share.sum() <= 0:
            best = max(self.languages, key=lambda x: (self.priors[x], [-ord(c) for c in x]))
            return best, self.priors[best] / max(sum(self.priors.values()), 1)
        best = int(np.argmax(share))  # of equal ones the first by name
        return self.languages[best], float(share[best] / share.sum())


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> Filters:
    """Filters from the labelled documents that aren't held out.

    A language with more than SAMPLE of them is learnt from about SAMPLE, drawn by the hash of doc_id: the bound of this
    fit, whatever the corpus. An n-gram goes into its language's filter if COMMON of the language's sampled documents
    have it, so a filter holds a few thousand n-grams at most.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Filters([], {})
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, min(1.0, SAMPLE / n)).otherwise(rate)
    drawn = labelled.filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long"))), F.lit(1_000_000)) < rate * 1_000_000)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = [np.unique(h) for h in ngram_hashes(text or "")]
                seen.setdefault(lang, []).append(np.unique(np.concatenate(own)))
                docs_of[lang] = docs_of.get(lang, 0) + 1
        for lang, hs in seen.items():
            h, n = np.unique(np.concatenate(hs), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "h", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.int64()), pa.array([docs_of[lang]])], ["lang", "h", "n"])

    counted = drawn.select("lang", "text").mapInArrow(grams, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    sampled = {lang: max(1.0, n * min(1.0, SAMPLE / n)) for lang, n in sizes.items()}
    least = F.lit(1e18)
    for lang, n in sampled.items():
        least = F.when(F.col("lang") == lang, max(1.0, COMMON * n)).otherwise(least)
    found = counted.filter(F.col("h").isNotNull() & (F.col("n") >= least)).select("lang", "h").toPandas()
    languages = sorted(sizes)
    return Filters(languages, {x: found.loc[found["lang"] == x, "h"].to_numpy().view(np.uint64) for x in languages}, sizes)


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang).

    Learnt (see learn()) from rows with a lang whose crc32(doc_id as text) mod 3 isn't 1, in which held_out is false.
    Each of a text's 2- to 4-grams is looked up in all languages' filters at once; a language's hits are corrected for
    its filter's false positives, and the largest corrected share wins (ties: the first by name). The whole text counts.
    `und` with score 0: a null or empty text, or one without a letter. A text with letters but no known n-gram gets the
    most frequent labelled language, with its share of the labels as score. Null doc_id: not held out. Rows that repeat
    get equal results. No labelled rows: all `und`. Languages are not limited in number: the filters grow by 2 MB for
    each 64. An empty table gives no rows; other columns are ignored. Texts are hashed a chunk at a time.
    """
    f = filters or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [f.predict(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
