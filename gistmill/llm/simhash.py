"""SimHash fingerprints and near-duplicate groups: by a byte-position inverted index with count filtering, or by shingle similarity."""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, columns_of
from .graph import connected_components

#: Bytes of a fingerprint, bits in which linked ones may differ, and (position, byte) pairs that a term is made of.
BYTES, RADIUS, TERM = 8, 2, 5
#: Terms that two linked fingerprints share at least: they agree on BYTES - RADIUS positions or more.
SHARED = comb(BYTES - RADIUS, TERM)
#: Posting lists up to this length are tallied pair by pair.
SHORT = 16


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """64-bit hashes of all runs of so many words of a UTF-8 text; of fewer words the hash of them all; of none no hash."""
    w = data.lower().split()  # of bytes: lower-cases A-Z and splits at [\x20\x09-\x0D] only
    if not w:
        return np.array([], np.uint64)
    text = b" ".join(w)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(text, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    first = [0, *ends[: len(w) - words].tolist()]
    last = (ends[words - 1 :] - 1).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, (text[a:b] for a, b in zip(first, last, strict=True)), repeat(42)), np.uint64, len(first))


def fingerprint(data: bytes, words: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text as a signed integer: a bit is 1 if set in over half the shingles' hashes."""
    return simhash(shingle_hashes(data, words))


def simhash(h: np.ndarray) -> int:
    """The signed SimHash of an array of hashes, zero of none."""
    if not len(h):
        return 0
    lanes, one = np.zeros((8, 8), np.int64), np.uint64(0x0101010101010101)
    pad = np.zeros(-len(h) % 255, np.uint64)
    blocks = np.concatenate([h, pad]).reshape(-1, 255)  # a byte counts up to 255 hashes
    for k in range(8):
        sums = ((blocks >> np.uint64(k)) & one).sum(axis=1, dtype=np.uint64)
        lanes[:, k] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0)
    bits = (2 * lanes.ravel() > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty and gives 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _paired(m: F.Column, reach) -> F.Column:
    """All {x, y} of an array in which y stands up to `reach` places after x."""
    return F.flatten(F.transform(m, lambda x, i: F.transform(F.slice(m, i + 2, reach), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def links(classes: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) that give the components of all pairs within RADIUS bits.

    With a radius of 3, the most that shared terms can promise, pairs 3 bits apart are added that share no long list.

    The index posts each fingerprint under every choice of 5 of its 8 (position, byte) pairs, 56 terms in all. Two
    fingerprints that differ in two bits agree on 6 positions or more and so share 6 terms at least, others by chance one.
    Short lists: each gives its pairs, the terms that a pair shares are tallied over all lists, pairs under the
    guaranteed minimum are dropped, and the rest verified by their differing bits. Lists under single bytes would hold
    1/256 of the corpus each.
    Long lists give no pairs: their members are posted again under themselves and their 64 one-bit changes, where two
    meet exactly if they differ in 2 bits or fewer, 65 at most under one term, and are linked to the least. A pair that
    shares a long list has both members there; any other pair shares short lists alone, so its tally is complete.
    """
    spark = classes.sparkSession
    masks = [_signed(sum(0xFF << 8 * p for p in at)) for at in combinations(range(BYTES), TERM)]
    terms = F.array(*[F.struct(F.lit(i).cast("byte").alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])
    posted = classes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("fp", F.explode(terms).alias("k")).select("k.i", "k.v", "fp")
    lists = posted.withColumn("n", F.count("*").over(Window.partitionBy("i", "v"))).filter("n > 1")
    lists = scratch.save(lists, "lists")

    m = F.col("m")
    met = lists.filter(F.col("n") <= SHORT).groupBy("i", "v").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    tallied = met.select(F.explode(_paired(m, F.lit(SHORT))).alias("p")).groupBy(F.col("p.x").alias("a"), F.col("p.y").alias("b")).agg(F.count("*").alias("shared"))
    shared = comb(BYTES - radius, TERM)  # SHARED for RADIUS
    pairs = tallied.filter((F.col("shared") >= shared) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")

    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64)])
    near = (
        lists.filter(F.col("n") > SHORT)
        .select("fp")
        .distinct()
        .select("fp", F.explode(flips).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("t"))
        .agg(F.collect_list("fp").alias("m"))
        .filter(F.size("m") > 1)
        .select(F.explode("m").alias("a"), F.array_min("m").alias("b"))
        .filter("a != b")
    )
    out = pairs.unionByName(near)
    out.used = (lists,)
    return out


def _components(nodes: DataFrame, edges: DataFrame, key: str, scratch: Scratch, *least: str) -> DataFrame:
    """(key, least): of each node of nodes (key, least) the least values in its component under edges (a, b)."""
    roots = connected_components(edges, scratch)
    rooted = scratch.save(nodes.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key)), "rooted")
    found = rooted.groupBy("root").agg(*[F.min(c).alias(c) for c in least])
    return rooted.select(key, "root").join(found, "root").drop("root")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    Texts are lower-cased in A-Z; words are `[^\\x20\\x09-\\x0D]+`, shingles three words (a shorter text: all its
    words; none: fingerprint zero, linked like any other). Fingerprints link at 2 or fewer differing bits;
    component_id is the smallest doc_id reachable. Exact copies meet in their fingerprint's class first, so only
    distinct fingerprints are compared. Rows with a null doc_id link like others, so chains go through them, and get
    their component's smallest id, null if it has none. Rows that repeat an id each get a result. An empty table gives no
    rows; other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    fps = scratch.save(fingerprints(docs), "fingerprints")
    nodes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("component_id")), "classes")
    labelled = _components(nodes, links(nodes.select("fp"), scratch), "fp", scratch, "component_id")
    return fps.join(labelled, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Documents whose shingles are counted to learn which are common, and how many of the commonest are remembered.
SAMPLED, COMMON = 5_000, 200_000
#: Up to so many ids of sets to compare are broadcast (8 bytes each); more are joined by a shuffle.
WANTED = 1_000_000


def row_key() -> F.Column:
    """{k1, k2}: 128 bits that stand for a row's doc_id and text."""
    return F.struct(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, k1, k2, fp, c, n, sh) of every row: its key, SimHash, a hash that names the set of shingles, its size, and the set as sorted hashes."""

    def run(batches):
        for b in batches:
            fps, names, sets = [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words)
                u = np.unique(h)
                fps.append(simhash(h))
                names.append(_signed(xxhash.xxh64_intdigest(u.tobytes(), 42)))
                sets.append(u.view(np.int64))
            sizes = [len(u) for u in sets]
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            sh = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.array([], np.int64), *sets])))
            cols = [b.column(0), b.column(2), b.column(3), pa.array(fps, pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), sh]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k1", "k2", "fp", "c", "n", "sh"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("k")).select("doc_id", "text", "k.k1", "k.k2")
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long, c long, n int, sh array<long>")


def least_overlap(share: float, n):
    """The least whole number of n shingles that is a share of them; a hair less, so that rounding loses none."""
    return np.ceil(share * n - 1e-9).astype(int)


def postings(sets: DataFrame, keys: np.ndarray, counts: np.ndarray, least: float) -> DataFrame:
    """(s, c, n, p): the rarest shingles of each set, with their place p in the order from rare to common.

    keys: common shingles in ascending order; counts: how often each was found.

    Two sets of similarity `least` share a shingle among the first n - least * n + 1 of each, whatever the order.
    """

    def run(batches):
        for b in batches:
            out = []
            for c, n, sh in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = sh.values.to_numpy()
                often = np.zeros(n, np.int64)
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    often = np.where(keys[i] == s, counts[i], 0)
                k = n - int(least_overlap(least, np.int64(n))) + 1
                s = s[np.lexsort((s, often))[:k]]
                out.append((s, np.full(len(s), c), np.full(len(s), n), np.arange(len(s))))
            if out:
                s, c, n, p = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(p, pa.int32())], ["s", "c", "n", "p"])

    return sets.select("c", "n", "sh").mapInArrow(run, "s long, c long, n int, p int")


def fingerprint_pairs(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of the c of sets (c, fp) that the inverted index finds, to be compared: each c of a fingerprint with its
    least, and the least of two fingerprints that differ in 3 bits or fewer (see links)."""
    classes = scratch.save(sets.groupBy("fp").agg(F.min("c").alias("c")), "fingerprints")
    index = links(classes.select("fp"), scratch, RADIUS + 1)
    left, right = (classes.select(F.col("fp").alias(k), F.col("c").alias("c" + k)) for k in "ab")
    across = index.join(left, "a").join(right, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    equal = sets.select("fp", F.col("c").alias("a")).join(classes.withColumnRenamed("c", "b"), "fp").select("a", "b")
    out = scratch.save(across.unionByName(equal).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "found")
    for x in (classes, *index.used):
        scratch.drop(x)
    return out


def similar_sets(sets: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(a, b): edges between the c of sets (c, fp, n, sh) that give the components of all pairs of similarity `least`; rows may repeat.

    Pairs that the index of SimHash fingerprints finds are compared first, by their exact sets, and join what they can.
    Similar texts can differ in more bits than any such index reaches; these meet in the list of a rare shingle (see
    postings), where only sets that aren't connected yet are compared: all pairs of a short list; in a long list first
    those next to each other in size. Then pairs of long lists are compared whose sets still aren't connected, so that a
    large group of near copies, once joined, gives no pairs. No list is cut.
    """
    total = sets.count()
    sample = sets.filter(F.pmod(F.xxhash64("c"), F.lit(max(1, total // SAMPLED))) == 0)
    often = sample.select(F.explode("sh").alias("s")).groupBy("s").count().filter("count > 1").orderBy(F.desc("count"), "s").limit(COMMON)
    common = often.orderBy("s").toArrow()  # columns, not rows: a small part of the driver's memory
    x = F.struct("n", "c", "p")
    lists = postings(sets, common.column("s").to_numpy(), common.column("count").to_numpy(), least).groupBy("s").agg(F.collect_set(x).alias("m")).filter(F.size("m") > 1).withColumn("m", F.array_sort("m"))
    lists = scratch.save(lists, "lists")

    def could(x, y):
        """Sizes allow it, and so do the shingles left after the shared one; x is the smaller set."""
        need = F.ceil(least / (1 + least) * (x["n"] + y["n"]) - 1e-9)
        return (x["n"] >= least * y["n"] - 1e-9) & (F.least(x["n"] - x["p"], y["n"] - y["p"]) >= need)

    def met(pairs: DataFrame, *columns: F.Column) -> DataFrame:
        """The pairs with n and `columns` of their two sets, a's and b's names ending in a and b."""
        ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "ids")
        few = F.broadcast(ids) if ids.count() <= WANTED else ids
        of = sets.join(few, "c", "left_semi").select("c", "n", *columns)
        names = of.columns[1:]
        wanted = scratch.save(of.groupBy("c").agg(*[F.first(x).alias(x) for x in names]), "wanted")
        left, right = (wanted.select(F.col("c").alias(k), *[F.col(x).alias(x + k) for x in names]) for k in "ab")
        out = pairs.join(left, "a").join(right, "b")
        out.used = (ids, wanted)
        return out

    def enough(overlap):
        return overlap >= least * (F.col("na") + F.col("nb") - overlap) - 1e-9

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that have the similarity. Few have, so most are told apart by a quarter of the hash space first.

        There, hashes are cut to 32 bits: two sets share no more than their cut hashes share and those that one's cut hashes
        hide, and elsewhere no more than the smaller one holds. So no similar pair goes; whole sets travel for the rest.
        """
        pairs = scratch.save(pairs.distinct(), "pairs")
        quarter = F.filter("sh", lambda x: x.bitwiseAND(F.lit(3)) == 0)
        cut = F.array_distinct(F.transform(quarter, lambda x: F.shiftright(x, 32).cast("int")))
        brief = met(pairs, F.size(quarter).alias("q"), cut.alias("t"))
        most = F.size(F.array_intersect("ta", "tb")) + F.col("qa") - F.size("ta") + F.least(F.col("na") - F.col("qa"), F.col("nb") - F.col("qb"))
        close = scratch.save(brief.filter(enough(most)).select("a", "b"), "close")
        whole = met(close, F.col("sh"))
        out = scratch.save(whole.filter(enough(F.size(F.array_intersect("sha", "shb")))).select("a", "b"), "similar")
        for x in (pairs, close, *brief.used, *whole.used):
            scratch.drop(x)
        return out

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose sets have different roots, or none."""
        for k in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("root").alias("r" + k)), k, "left")
        return pairs.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")

    found = fingerprint_pairs(sets, scratch)
    by_print = similar(found)
    scratch.drop(found)
    m, reach = F.col("m"), F.when(F.size("m") <= SHORT, SHORT).otherwise(1)
    met_in_lists = lists.select(F.explode(F.filter(_paired(m, reach), lambda q: could(q["x"], q["y"]))).alias("q")).select(F.col("q.x.c").alias("a"), F.col("q.y.c").alias("b"))
    first = by_print.unionByName(similar(apart(met_in_lists.distinct(), connected_components(by_print, scratch))))
    roots = connected_components(first, scratch)
    rows = lists.filter(F.size("m") > SHORT).select("s", F.explode("m").alias("x"))
    rows = rows.join(roots, F.col("x.c") == roots.node, "left").select("s", "x", F.coalesce("root", "x.c").alias("root"))
    open_ = rows.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("s")
    rows = scratch.save(rows.join(open_, "s", "left_semi"), "open")
    other = rows.select("s", F.col("x").alias("y"), F.col("root").alias("root2"))
    meet = (F.col("root") != F.col("root2")) & (F.struct("x.n", "x.c") < F.struct("y.n", "y.c")) & could(F.col("x"), F.col("y"))
    second = similar(rows.join(other, "s").filter(meet).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")))
    for x in (lists, rows):
        scratch.drop(x)
    return first.unionByName(second)


def _labelled(docs: DataFrame, scratch: Scratch, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k1, k2, fp, c), and of each c its component's smallest doc_id and first row: (c, component_id, first)."""
    sets = scratch.save(shingle_sets(docs, words), "sets")
    rows = scratch.save(sets.select("doc_id", "k1", "k2", "fp", "c"), "rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    nodes = scratch.save(rows.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(first).alias("first")), "classes")
    edges = similar_sets(sets.filter("n > 0").select("c", "fp", "n", "sh"), least, scratch)
    scratch.drop(sets)
    return rows, _components(nodes, edges, "c", scratch, "component_id", "first")


def near_copies(docs: DataFrame, scratch: Scratch | None = None, words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text), linked by similarity of shingles.

    Documents link if the Jaccard similarity of their sets of `words`-word shingles is `least` or more; component_id is
    the smallest doc_id reachable. Words, short and empty texts, null ids, repeats and empty tables are as in
    near_duplicates(). Such texts differ in about 10 bits of a SimHash and may in over 20, and blocks for that radius
    would hold a sixth of the corpus each; so those that differ in 3 bits or fewer meet in the index of fingerprints, the
    rest by their rarest shingles, which loses none, and all are compared exactly. Equal 64-bit hashes count as equal shingles and as equal sets.
    """
    rows, labelled = _labelled(docs, scratch or Scratch(docs.sparkSession), words, least)
    return rows.join(labelled, "c", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_copies(docs: DataFrame, scratch: Scratch | None = None, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row, with all its columns, of each group of near_copies(): that with the smallest doc_id (none: after all others).

    Rows with one doc_id and different texts are different documents. Of rows that are equal in doc_id and text one stays,
    that with the least hash of its columns. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows, labelled = _labelled(docs, scratch, words, least)
    first = scratch.save(labelled.select("first.k1", "first.k2").distinct(), "first")
    repeated = scratch.save(rows.join(first, ["k1", "k2"], "left_semi").groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2"), "repeated")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.select(row, row_key().alias("k")).select("row", "k.k1", "k.k2").join(first, ["k1", "k2"], "left_semi")
    if repeated.limit(1).count():
        by = F.xxhash64(*[F.col("row").getField(f.name) for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)])
        once = kept.join(repeated, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by("row", by).alias("row"))
        kept = kept.join(repeated, ["k1", "k2"], "left_anti").unionByName(once)
    return kept.select(*columns_of(docs))
