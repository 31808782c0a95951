"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns_of, keyed

#: Words of a shingle, least similarity, and bits in which fingerprints of similar windows may differ.
WORDS, LEAST, RADIUS = 5, 0.8, 23
#: A benchmark of up to so many shingles is broadcast (16 bytes each); a larger one is joined by a shuffle.
BROADCAST = 1_000_000


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks of 64 bits: two fingerprints within the radius agree on one block at least."""
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, (1 << b - a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def words(text) -> F.Column:
    """Maximal runs of letters, marks and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(w) -> F.Column:
    """64-bit hashes of all runs of WORDS words; of fewer words the hash of them all; of none no hash."""
    count = F.greatest(F.size(w) - (WORDS - 1), F.least(F.size(w), F.lit(1)))
    # get() takes one step where slice() walks over the whole array, and is null (which a hash skips) beyond its end
    hashed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
    return F.when(count > 0, hashed).otherwise(F.expr("cast(array() as array<bigint>)"))


def hashed(texts: DataFrame, *keep: str) -> DataFrame:
    """keep and sh, the shingles of _text. The words are a column of their own, as an expression inside the shingles' lambda would be evaluated for each shingle."""
    return texts.select(*keep, words(F.col("_text")).alias("_w")).select(*keep, shingles(F.col("_w")).alias("sh"))


def simhash(hashes) -> F.Column:
    """The 64-bit fingerprint of an array of hashes: a bit is 1 if set in over half of them, repeats included."""

    def bit(acc, b):
        ones = F.size(F.filter(hashes, lambda x: F.getbit(x, b) == 1))
        return F.when(2 * ones > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def similarity(a, b) -> F.Column:
    """Weighted Jaccard similarity of two arrays of hashes; a hash weighs as often as it occurs."""
    count = lambda c, s: F.size(F.filter(c, lambda x: x == s))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, s: n + F.least(count(a, s), count(b, s)))
    return both / (F.size(a) + F.size(b) - both)


def matches(distinct: DataFrame, benchmark: DataFrame, scratch: Scratch, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """(_did, _sub, item_id, similarity): the benchmark items that a document contains, with the best window's similarity.

    Windows: they have the item's size and start anywhere, also before the document's start or near its end, where they
    are shorter. A window as similar as asked holds a share of `least` of its item's shingles, so only documents
    and places with so many shared shingles (in whatever order) can have one. Any such window is at most as similar as
    one that starts at a shared shingle or, where it would start before the document, ends at one: moving it there loses
    none and makes it no longer. So these windows are fingerprinted and the others need none. Index: fingerprints of
    windows and items are cut into radius + 1 blocks; a window finds the items of its size that agree with it on a block,
    among which are all within the radius by the pigeonhole principle, and these are then compared bit by bit. Distinct
    fingerprints meet, so copies of a window cost nothing here. Verification: weighted similarity of the shingles.
    """
    texts = benchmark.filter("item_id is not null and text is not null").select("item_id", F.col("text").alias("_text"))
    items = scratch.save(hashed(texts, "item_id").withColumnRenamed("sh", "ish").distinct(), "items").filter("size(ish) > 0")
    seeds = scratch.save(items.select("item_id", F.size("ish").alias("n_ish"), F.explode("ish").alias("s")).distinct(), "seeds")
    small = seeds.count() <= BROADCAST
    keep = F.broadcast if small else lambda x: x
    # the outer form, as a plain explode infers a filter on the array's size that is pushed to the scan and computes it anew
    hits = hashed(distinct, "_did", "_sub").select("_did", "_sub", F.posexplode_outer("sh").alias("p", "s")).join(keep(seeds), "s")
    need = F.ceil(least * F.col("n_ish") - 1e-9).cast("int")
    places = hits.groupBy("_did", "_sub", "item_id", "n_ish").agg(F.array_sort(F.collect_set("p")).alias("ps")).filter(F.size("ps") >= need)
    at, n = F.col("ps"), F.col("n_ish")
    from_hit = F.filter(at, lambda p, i: F.get(at, i + need - 1) < p + n)
    to_hit = F.transform(F.filter(at, lambda p, i: (i + 1 >= need) & (p + 1 < n)), lambda p: p + 1 - n)
    starts = places.select("_did", "_sub", "n_ish", F.explode(F.array_distinct(F.concat(from_hit, to_hit))).alias("start"))
    starts = scratch.save(starts.distinct(), "starts")

    marked = starts.groupBy("_did", "_sub").agg(F.collect_list(F.struct("start", "n_ish")).alias("at"))
    begin, stop = F.greatest(F.col("at.start"), F.lit(0)), F.least(F.col("at.start") + F.col("at.n_ish"), F.size("sh"))
    windows = (
        hashed(distinct.join(marked.hint("shuffle_hash"), ["_did", "_sub"]), "_did", "_sub", "at")
        .select("_did", "_sub", "sh", F.explode("at").alias("at"))
        .select("_did", "_sub", F.col("at.n_ish").alias("n"), F.slice("sh", begin + 1, stop - begin).alias("wsh"))
        .select("*", simhash(F.col("wsh")).alias("wfp"))
    )
    windows = scratch.save(windows.distinct(), "windows")

    def posted(fp: str) -> F.Column:
        parts = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit(m)).alias("v")) for i, (a, m) in enumerate(blocks(radius))]
        return F.explode(F.array(*parts)).alias("block")

    prints = scratch.save(items.select("item_id", "ish", F.size("ish").alias("n"), simhash(F.col("ish")).alias("ifp")), "prints")
    index = prints.select("item_id", "n", "ifp", posted("ifp"))
    met = windows.select("n", "wfp", posted("wfp")).distinct().join(index, ["n", "block"])
    near = met.filter(F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp"))) <= radius).select("n", "wfp", "item_id").distinct()
    scored = windows.join(near, ["n", "wfp"]).join(prints.select("item_id", "ish"), "item_id").select("_did", "_sub", "item_id", similarity(F.col("ish"), F.col("wsh")).alias("similarity"))
    return scored.filter(F.col("similarity") >= least).groupBy("_did", "_sub", "item_id").agg(F.max("similarity").alias("similarity"))


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """docs with contaminated (boolean), n_items and items (sorted item_ids, comma-joined) added.

    A document is contaminated by an item if a window of it with as many five-word shingles as the item (fewer where the
    document begins or ends), at any start, has a weighted Jaccard similarity of `least` or more. Words are runs of letters, marks and digits in lower case. An item of fewer than five words matches
    only a document of just these words; one without words, id or text matches none. Equal items under different ids are
    all named. Null or empty text: not contaminated. Rows that repeat get equal results, also with a null doc_id. An
    empty table of documents gives no rows, an empty benchmark contaminates nothing. Columns of docs stay, but for those
    named like the added ones. Similar windows differ in about 10 of 64 bits; the radius of 23 keeps any that could pass.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.drop("contaminated", "n_items", "items")
    rows, distinct = keyed(docs)
    found = matches(distinct, benchmark, scratch, radius, least).groupBy("_did", "_sub").agg(F.array_sort(F.collect_set("item_id")).alias("found"))
    found = scratch.save(found, "found")
    return rows.join(found.hint("shuffle_hash"), ["_did", "_sub"], "left").select(
        *columns_of(docs),
        F.col("found").isNotNull().alias("contaminated"),
        F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("found", lambda x: x.cast("string")), ","), F.lit("")).alias("items"),
    )


ORACLE = r"""with dw as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') as w from documents),
bw as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') as w from benchmark),
ds as materialized (select doc_id, i - 1 as p, array_to_string(w[i:i + 4], ' ') as s from (select *, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from dw)),
bs as materialized (select item_id, i - 1 as q, array_to_string(w[i:i + 4], ' ') as s, count(*) over (partition by item_id) as n
  from (select *, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from bw)),
st as materialized (select distinct doc_id, item_id, p - q as start, n from ds join bs using (s)),
ws as (select st.doc_id, st.item_id, st.start, st.n, ds.s, count(*) as c from st join ds on ds.doc_id = st.doc_id and ds.p >= st.start and ds.p < st.start + st.n group by all),
bc as (select item_id, s, count(*) as c from bs group by all),
sim as (select ws.doc_id, ws.item_id, ws.start, sum(least(ws.c, coalesce(bc.c, 0))) as inter, sum(ws.c) as n_w, any_value(ws.n) as n_i
  from ws left join bc on bc.item_id = ws.item_id and bc.s = ws.s group by all),
hit as (select distinct doc_id, item_id from sim where inter / (n_w + n_i - inter) >= 0.8)
select d.doc_id, count(h.item_id) > 0 as contaminated, count(h.item_id) as n_items, coalesce(string_agg(h.item_id::varchar, ',' order by h.item_id), '') as items
from documents d left join hit h on d.doc_id = h.doc_id group by d.doc_id"""
