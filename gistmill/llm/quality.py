"""Quality rules whose votes are weighed by weak supervision."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns_of, whole_text

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\t\n\x0b\x0c\r"
WINDOW = 8
SIGNS = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
LETTERS = re.compile(r"[\W\d_]+")
#: Votes are kept as one digit a rule: 0 bad, 1 good, 2 abstains.
BAD, GOOD, ABSTAIN = 0, 1, 2


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the text, the first copy included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    h = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    roll = np.zeros(n, np.uint64)
    for k in range(window):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] + np.uint64(1)
    order = np.argsort(roll, kind="stable")
    same = roll[order][1:] == roll[order][:-1]
    if not same.any():
        return 0
    often: dict[tuple[bytes, ...], list[int]] = {}  # equal hashes are only candidates
    for i in np.union1d(order[1:][same], order[:-1][same]).tolist():
        often.setdefault(tuple(words[i : i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for at in often.values():
        if len(at) > 1:
            np.add.at(edge, at, 1)
            np.add.at(edge, np.array(at) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines with a word, letters, capitals and words of signs."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    n_lines = dups = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n_lines += 1
            dups += line in seen
            seen.add(line)
    letters, low = LETTERS.sub("", text), text.lower()
    capitals = sum(a != b for a, b in zip(text, low, strict=False)) if text != low else 0
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dups, repeated_words(words), n_lines, len(letters), capitals, len(SIGNS.findall(text))


def votes(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, n_lines: int, letters: int, capitals: int, signs: int) -> list[int]:
    """One vote a rule. Between its two bounds a rule abstains."""

    def rule(value: float, good: float, bad: float) -> int:
        """Good up to the one bound, bad from the other on."""
        return GOOD if value <= good else BAD if value >= bad else ABSTAIN

    n = max(n_words, 1)
    return [
        BAD if n_words < 20 else ABSTAIN if n_words < 40 else GOOD,
        rule(100 * n_symbols / n, 2, 10),
        rule(signs / n, 0.05, 0.2),
        rule(1 - letters / max(word_chars, 1), 0.1, 0.2),
        rule(n_dup_lines / max(n_lines, 1), 0.1, 0.4),
        rule(n_repeat_words / n, 0.1, 0.3),
        rule(capitals / max(letters, 1), 0.15, 0.4),
        rule(abs(word_chars / n - 6), 3, 5),
    ]


RULES = 8
#: What is believed of a rule beforehand: the share of its votes on good documents that are good, that of its votes on
#: bad documents that are bad, and the weight of this belief as a share of all documents, so that it holds at every size.
TRUST_GOOD, TRUST_BAD, WEIGHT = 0.98, 0.5, 0.2


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, pattern) of every row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measures(x.as_py() or "") for x in b.column(1)]
            patterns = [sum(v * 3**k for k, v in enumerate(votes(*r))) for r in rows]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(patterns, pa.int64())], ["doc_id", *names, "pattern"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, pattern long")


def estimate(counts: dict[int, int], rules: int = RULES, rounds: int = 100) -> dict[int, float]:
    """The posterior probability of good for each vote pattern, by expectation-maximisation over the patterns' counts.

    A rule is right about good documents and about bad ones with two chances of its own; votes are independent given
    the class, and an abstention says nothing. The estimates are the most probable ones under a belief about rules
    (TRUST_GOOD, TRUST_BAD, WEIGHT), which also tells the two classes apart. A pattern in which all abstain gets the
    share of good documents.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    v = np.array([[p // 3**k % 3 for k in range(rules)] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    cast, good = v != ABSTAIN, v == GOOD
    right = np.array([[TRUST_BAD] * rules, [TRUST_GOOD] * rules])  # for bad and good documents
    belief, prior = right * (weight := WEIGHT * n.sum()), 0.8
    for _ in range(rounds):
        say_good = np.array([1 - right[0], right[1]])  # the chance of a good vote in each class
        logs = np.where(good[None], np.log(say_good)[:, None], np.log1p(-say_good)[:, None]) * cast[None]
        score = logs.sum(axis=2)
        post = 1 / (1 + (1 - prior) / prior * np.exp(np.clip(score[0] - score[1], -700, 700)))
        w = np.stack([n * (1 - post), n * post])
        hits = np.stack([(w[0, :, None] * (cast & ~good)).sum(axis=0), (w[1, :, None] * (cast & good)).sum(axis=0)])
        right = np.clip((hits + belief) / ((w[:, :, None] * cast).sum(axis=1) + weight), 1e-6, 1 - 1e-6)
        prior = (w[1].sum() + 0.8 * weight) / (n.sum() + weight)
    return dict(zip(patterns, post.tolist(), strict=True))


def quality(docs: DataFrame, least: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior, kept), a row for each row.

    Eight rules (words, symbols, words of signs, letters, repeated lines, repeated 8-word windows, capitals, length of words) vote good or bad or
    abstain. The patterns of votes are counted over all rows (3**8 at most go to the driver), expectation-maximisation
    over these counts estimates each rule's accuracy, and a document is kept if its posterior probability of good
    reaches `least` and it doesn't fail the base rules (n_words < 20, or 100 * n_repeat_words > 30 * n_words).
    A null text counts as empty: zero words, fails. Ties and repeated rows get equal results. An empty table gives no
    rows; other columns are ignored. Texts are measured once, row by row, and their measures written to the shared folder.
    """
    m = (scratch or Scratch(docs.sparkSession)).save(measured(docs), "measures")
    found = {r["pattern"]: r["count"] for r in m.groupBy("pattern").count().collect()}
    rows = [(p, round(x, 12)) for p, x in estimate(found).items()]
    table = docs.sparkSession.createDataFrame(rows, "pattern long, posterior double")  # 3**8 rows at most
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.join(F.broadcast(table), "pattern", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "posterior", (~failed & (F.coalesce("posterior", F.lit(0.0)) >= least)).alias("kept"),
    )


def kept_rows(docs: DataFrame, least: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that quality() keeps.

    Texts are measured once; what is written to the shared folder is their vote patterns under 128-bit hashes of the
    texts, not the texts, and then the distinct hashes that are rejected, which an anti-join takes out. Rows with equal
    texts get the same verdict.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = whole_text(F.col("text"))
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measures(x.as_py()) for x in b.column(0)]
            patterns = [(sum(v * 3**k for k, v in enumerate(votes(*r))), r[0] < 20 or 100 * r[4] > 30 * r[0]) for r in rows]
            # rows that fail the base rules vote, but are negative, as they can't be kept
            own = pa.array([-1 - p if failed else p for p, failed in patterns], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), own], ["k1", "k2", "pattern"])

    marked = scratch.save(docs.select(text.alias("text"), *keys).mapInArrow(run, "k1 long, k2 long, pattern int"), "patterns")
    pattern = F.when(F.col("pattern") < 0, -1 - F.col("pattern")).otherwise(F.col("pattern"))
    found = {r["p"]: r["count"] for r in marked.groupBy(pattern.alias("p")).count().collect()}
    good = [p for p, x in estimate(found).items() if round(x, 12) >= least]
    rejected = scratch.save(marked.filter(~F.col("pattern").isin(good)).select("k1", "k2").distinct(), "rejected")
    scratch.drop(marked)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *keys).join(rejected, ["k1", "k2"], "left_anti").select(*columns_of(docs))
