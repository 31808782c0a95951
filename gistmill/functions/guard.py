"""The lexical guard of the semantic cache: whether one prompt's answer can serve another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and stems whose one-sided change turns a prompt's meaning: fixed values.
ANTONYMS = (("enable", "disable"), ("on", "off"), ("add", "remove"), ("always", "never"), ("con", "sin"), ("increase", "decrease"), ("create", "delete"), ("start", "stop"))
STEMS = (
    (("crea", "cread"), ("borr", "elimin")),
    (("activ",), ("desactiv",)),
    (("conect",), ("desconect",)),
    (("instal",), ("desinstal",)),
    (("encend", "encien"), ("apag",)),
    (("sub",), ("baj",)),
    (("abr", "abri"), ("cerr", "cierr")),
    (("anad", "agreg"), ("quit",)),
    (("inici", "arranc", "empie", "empez"), ("deten", "detien", "par")),
    (("permit",), ("deneg", "denie", "prohib", "bloque")),
    (("mostr", "muestr"), ("ocult", "escond")),
)
NEGATIONS = ("not", "no", "nunca", "jamas", "sin", "tampoco")
MONTHS = (
    "january february march april may june july august september october november december "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
).split()
NUMBER = r"\d{4}-\d{2}-\d{2}|\d+(?:\.\d+)?"
#: Latin letters with marks and what they are without: fixed values. Marks that stand alone are taken out.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīńňōőřśšťūůűźžż"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeginnoorsstuuuzzz"


def plain(text: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}", "")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}]+"), F.lit(0)))


def numeric_tokens(text: Column) -> Column:
    """Sorted distinct numbers, ISO dates and names of months."""
    months = F.array_intersect(_words(F.lower(text)), F.array(*map(F.lit, MONTHS)))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), months)))


def guard_words(text: Column) -> Column:
    return _words(F.regexp_replace(plain(text), "n['’]t\\b", " not"))


def features(text: Column) -> Column:
    """struct<numbers, words>: all that safe() needs of a text: make it a column where a text meets many others."""
    return F.struct(numeric_tokens(text).alias("numbers"), _tags(text).alias("words"))


#: Bits of negations, and of the one side of all pairs of opposites; the bit above such a bit is the pair's other side.
NEGATED = (1 << len(NEGATIONS)) - 1
ONE_SIDE = sum(1 << len(NEGATIONS) + 2 * k for k in range(len(ANTONYMS) + len(STEMS)))


def _tags(text: Column) -> Column:
    """A bit for each negation and each side of a pair of opposites that the words of a text hold."""
    exact = [*NEGATIONS, *(side for pair in ANTONYMS for side in pair)]
    begun = [side for pair in STEMS for side in pair]

    def bits(w: Column) -> Column:
        own = F.lit(0).cast("long")
        for k, word in enumerate(exact):
            own = own.bitwiseOR(F.when(w == word, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        for k, stems in enumerate(begun, len(exact)):
            own = own.bitwiseOR(F.when(w.rlike(f"^(?:{'|'.join(stems)})"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        return own

    return F.aggregate(guard_words(text), F.lit(0).cast("long"), lambda found, w: found.bitwiseOR(bits(w)))


def safe_features(a: Column, b: Column) -> Column:
    """safe() of two features()."""
    x, y = a["words"], b["words"]
    one, other = (lambda w: w.bitwiseAND(F.lit(ONE_SIDE))), (lambda w: F.shiftright(w, 1).bitwiseAND(F.lit(ONE_SIDE)))
    only = lambda p, q: p.bitwiseAND(F.bitwise_not(q))
    crossed = only(one(x), other(x)).bitwiseAND(only(other(y), one(y))).bitwiseOR(only(other(x), one(x)).bitwiseAND(only(one(y), other(y))))
    return (a["numbers"] == b["numbers"]) & (x.bitwiseXOR(y).bitwiseAND(F.lit(NEGATED)) == 0) & (crossed == 0)


def safe(a: Column, b: Column) -> Column:
    """Numbers and dates are the same, no negation is on one side only, and no pair of opposites is split between the texts."""
    return safe_features(features(a), features(b))
