"""Text functions as native columns.

Java's \\w, \\s and ^ differ from Unicode-aware ones, so classes are spelled out: word characters are letters, digits and
the underscore, white space is Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes and line breaks: fixed values.
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x1f \x85\p{Z}"
BREAK = r"(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ])"

#: English words that carry no content: fixed values.
STOPWORDS = (
    "the a an and or but in on at to for of with is was were are be been it this that he she they we i you his her their our my your them us him me "
    "as by from about into through over under again then once here there when where why how all any both each few more most other some such no nor "
    "not only own same so than too very can will just should would now"
).split()

#: English words that don't anchor a query, apostrophes left out: fixed values.
ANCHOR_STOPWORDS = (
    "a about above after again against all am an and any are arent as at be because been before being below between both but by cant cannot could couldnt "
    "did didnt do does doesnt doing dont down during each few for from further had hadnt has hasnt have havent having he hed hell hes her here heres hers "
    "herself him himself his how hows i id ill im ive if in into is isnt it its itself lets me more most mustnt my myself no nor not of off on once only or "
    "other ought our ours ourselves out over own same shant she shed shell shes should shouldnt so some such than that thats the their theirs them "
    "themselves then there theres these they theyd theyll theyre theyve this those through to too under until up very was wasnt we wed well were weve "
    "werent what whats when whens where wheres which while who whos whom why whys with wont would wouldnt you youd youll youre youve your yours yourself "
    "yourselves"
).split()


def token_count(text: Column) -> Column:
    """Estimated tokens: the mean of length / 4 and the number of words and marks, rounded half to even; 0 for an empty text, else 1 at least."""
    pieces = F.regexp_count(text, F.lit(f"[{WORD}]+|[^{WORD}{SPACE}]"))
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.bround((F.length(text) / 4 + pieces) / 2).cast("int"))).cast("long")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def split_lines(text: Column) -> Column:
    """Lines at any Unicode line break; a break at the end starts no further line; an empty text has none."""
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.regexp_replace(text, BREAK + r"\z", ""), BREAK, -1))


def identifiers(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))


def anchors(query: Column) -> Column:
    """The identifiers of a query that aren't stop words; all of them if none is left."""
    found = identifiers(query)
    content = F.array_except(found, F.array(*map(F.lit, ANCHOR_STOPWORDS)))
    return F.when(F.size(content) > 0, content).otherwise(found)


def content_words(text: Column) -> Column:
    """Lower-case ASCII words that stand alone and aren't stop words, in order, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![{WORD}])[a-zA-Z0-9]+(?![{WORD}])"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(found, lambda w: ~F.array_contains(stop, w))


def sentences(paragraph: Column) -> Column:
    """Parts after which white space follows a full stop, exclamation or question mark; stripped, empty ones left out."""
    return F.filter(F.transform(F.split(paragraph, rf"(?<=[.!?])[{SPACE}]+", -1), strip), lambda s: s != "")


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays' distinct values; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def optimal_k(n: Column, ratio: float = 0.2, min_k: int = 1, max_k: int | None = None, decay: float = 0.5) -> Column:
    """How many of n items to keep: ceil(ratio * n ** (1 - decay)), min_k at least, n and max_k at most."""
    ratio, decay = min(max(ratio, 0.0), 1.0), min(max(decay, 0.0), 1.0)
    k = F.greatest(F.ceil(F.lit(ratio) * F.pow(n.cast("double"), F.lit(1.0 - decay))), F.least(F.lit(min_k), n))
    if max_k is not None:
        k = F.least(k, F.lit(max_k))
    return F.when(n <= 0, 0).otherwise(F.least(k, n)).cast("long")


def split_budget(k: Column, head: int = 5, tail: int = 3) -> Column:
    """{head, tail}: k shared out as head : tail, rounded half to even; a single one goes to the head."""
    h = F.when(k <= 0, 0).when(k == 1, 1).otherwise(F.least(F.bround(k * head / (head + tail)), k)).cast("long")
    return F.struct(h.alias("head"), (F.greatest(k, F.lit(0)) - h).cast("long").alias("tail"))
