"""Secret scans: fixed patterns, and guess-cost of values that stand in a credential context."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of spans in the order that ties in start follow; the last is the method's.
KINDS = ("assign", "access", "hex", "guess")
#: The base patterns: fixed values.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run: shorter ones fail anyway
LEAST = {"assign": 6, "access": 20}
#: Where a credential is named and a value follows, in quotes or up to white space.
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|private[_-]?key|auth(?:orization)?|bearer)[\"']?"
    r"(?:\x20*[:=]\x20*|(\x20is\x20))(?:bearer\x20|basic\x20)?(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"'<>,;]{6,}))",
    re.IGNORECASE | re.ASCII,
)
#: Words that guesses start from, in the order in which they are tried: fixed values.
WORDS = (
    "password pass word admin welcome login user test guest root letmein master secret token key love hello dragon monkey sunshine princess football "
    "baseball shadow superman batman qwerty abc iloveyou trust hunter summer winter spring autumn monday friday january june july august october "
    "changeme default example sample dummy none null true false this that the and for with from your here value string name text please enter is of in"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Words that are learnt from the corpus at most, and their letters.
LEARNT, SHORTEST, SPAN = 20_000, 3, 16
#: What stands for a letter in a guess: fixed values. A 1 stands for i or l.
LEET = str.maketrans("@4830$57!1", "aabeosstii")
LEET_L = str.maketrans("@4830$57!1", "aabeosstil")
#: Rows of a keyboard, as pairs of neighbours: a walk along them costs little.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {(a, b) for r in ROWS for a, b in zip(r, r[1:], strict=False)}
NEXT |= {(b, a) for a, b in NEXT}
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
#: A value is a secret if guessing it takes 10 to this power of tries or more.
STRONG = 10.0


def _class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def learn_words(docs: DataFrame, most: int = LEARNT) -> dict[str, int]:
    """The rank of each word in the order in which guesses try them: WORDS, then the `most` most frequent words of all texts.

    Learnt words are runs of 3 to 16 letters a-z, counted over whole texts; ties go by name. Words of one letter repeated
    are left out, as repeats have a cost of their own. Nothing but the `most` words goes to the driver.
    """
    word = F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("word")
    counted = docs.select(word).filter(F.length("word").between(SHORTEST, SPAN)).groupBy("word").count()
    counted = counted.filter(~F.col("word").rlike(r"^(.)\1*$")).orderBy(F.desc("count"), "word").limit(most)
    rank = dict(RANK)
    for r in counted.collect():
        rank.setdefault(r["word"], len(rank) + 1)
    return rank


def _patterns(word: str) -> int:
    """How many ways of setting capitals are tried up to this word's own: none, the first or all, else any so many."""
    up, n = sum(map(str.isupper, word)), len(word)
    if up == 0:
        return 1
    if up == n or (up == 1 and word[0].isupper()):
        return 2
    return 2 + sum(math.comb(n, k) for k in range(1, min(up, n - up) + 1))


def guess_cost(value: str, rank: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation of value into words, dates, repeats, keyboard walks and brute force.

    best[i] is the least cost of the first i characters. A span costs: a word its rank, times the patterns of capitals
    tried before its own, times 2 for each letter that a sign or digit stands for; a date 365 * 119 (a year 119); a repeat of three or
    more of one character its class times its length; a walk of three or more keys along a keyboard row 50 starts times 2
    for each step; any other character its class. Spans but single characters cost a factor of 2 more.

    The cost is linear in the length. Words and dates are bounded. A walk's cost grows by a constant a step, so the best
    start so far is carried along. A repeat starts within SPAN of its run's start: inside a run there are no words or
    dates, and a split of one costs more than the longer repeat.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer: letter by letter
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in value)
    forms = [low]
    for table in (LEET, LEET_L):
        if (form := low.translate(table)) not in forms:
            forms.append(form)
    best = [0.0] + [math.inf] * n
    two, step = math.log10(2), math.log10(2)
    run = walk = 0  # length of the repeat and of the walk that end here
    carried = math.inf  # of the walk: the least best[j] - j * step of its starts j
    for i in range(1, n + 1):
        c, brute = low[i - 1], math.log10(_class_size(value[i - 1]))
        run = run + 1 if i > 1 and value[i - 2] == value[i - 1] else 1
        walk = walk + 1 if i > 1 and (low[i - 2], c) in NEXT else 1
        now = best[i - 1] + brute
        for k in range(run, max(2, run - SPAN - 1), -1):
            now = min(now, best[i - k] + brute + math.log10(2 * k))
        if walk == 1:
            carried = math.inf
        elif walk >= 3:
            carried = min(carried, best[i - 3] - (i - 3) * step)
            now = min(now, carried + (i - 1) * step + math.log10(50) + two)
        for k in range(2, min(SPAN, i) + 1):
            for form in forms:
                if (r := rank.get(form[i - k : i])) is not None:
                    signs = sum(a != b for a, b in zip(form[i - k : i], low[i - k : i], strict=True))
                    now = min(now, best[i - k] + math.log10(r * _patterns(value[i - k : i])) + (signs + 1) * two)
        for k in (4, 8, 10):
            if k <= i and DATE.fullmatch(value, i - k, i):
                now = min(now, best[i - k] + math.log10(365 * 119 if k > 4 else 119) + two)
        best[i] = now
    return best[n]


def spans(text: str, strong: float = STRONG, rank: dict[str, int] = RANK) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's secrets by start, then kind: code points, end exclusive."""
    found = []
    folded = text.lower()
    if any(k in folded for k in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(k in folded for k in ("pass", "pwd", "secret", "token", "api", "credential", "private", "auth", "bearer")):
        for m in CONTEXT.finditer(text):
            g = m.lastindex
            prose = m[1] and m[g].isalpha()  # "the password is required"
            if not prose and guess_cost(m[g], rank) >= strong:
                found.append((m.start(g), m.end(g), "guess"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, strong: float = STRONG, rank: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, found array<struct<start, end, kind>>) of every row of docs (doc_id, text).

    assign, access and hex are fixed patterns, leftmost and non-overlapping for each kind. guess: the value that follows
    a credential's name, where the cheapest way to guess it (guess_cost()) takes 10**strong tries or more, so that a
    placeholder made of words, dates, repeats or keyboard walks isn't reported; words are those of the corpus itself (see
    learn_words()) unless `rank` is given. Positions are code points of the whole
    text, end exclusive. A null or empty text has none. Rows that repeat get equal results. An empty table gives no rows;
    other columns are ignored. Texts are scanned row by row, so memory is bounded by a batch.
    """
    rank = learn_words(docs) if rank is None else rank
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(x.as_py() or "", strong, rank)] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, found array<struct<start: long, end: long, kind: string>>")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) of scan()."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"] != "guess")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
