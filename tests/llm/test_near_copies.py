import corpus_pipeline
import numpy as np
from gistmill.llm import simhash
from gistmill.llm.common import Scratch


def sets(texts):
    out = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        out[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def groups(texts, least=0.8):
    """Components over all pairs, by looking at every one."""
    s, root = sets(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and (s[a] == s[b] or len(s[a] & s[b]) >= least * len(s[a] | s[b]) - 1e-9):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def texts_of(rng):
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    common, texts = word(60), []
    for n in (6, 8, 12, 30, 100, 250):
        for _ in range(6):
            base = word(n)
            texts.append(base)
            for edits in rng.integers(0, 1 + n // 25, 4):  # about the limit of 0.8
                copy = list(base)
                for k in rng.integers(0, n, edits):
                    copy[k] = "edit"
                texts += [copy, [*copy, *word(n // 20)]]
    texts += [[*common, *word(12)] for _ in range(40)]  # a common passage, not similar as a whole
    for _ in range(60):  # one large group of near copies
        copy = list(common)
        copy[int(rng.integers(0, 60))] = f"x{rng.integers(0, 50)}"
        texts.append(copy)
    return {i: " ".join(t) for i, t in enumerate([*texts, [], [], ["one"], ["One"], ["one", "two"]])}


def test_near_copies_equal_brute_force(spark):
    texts = texts_of(np.random.default_rng(5))
    want = groups(texts)
    got = simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < len(texts)


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    base = [f"w{i}" for i in range(200)]
    copy = [*base[:60], "new", *base[61:140], "other", *base[141:]]
    far = [*base[:100], *[f"v{i}" for i in range(100)]]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(far))], "doc_id long, text string")
    assert bin(simhash.fingerprint(" ".join(base).encode()) ^ simhash.fingerprint(" ".join(copy).encode())).count("1") > 2
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {1, 3}


def test_fingerprints_in_the_index_link_first(spark):
    texts = texts_of(np.random.default_rng(7))
    sets_ = simhash.shingle_sets(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5)
    scratch = Scratch(spark)
    got = {(r["a"], r["b"]) for r in simhash.fingerprint_pairs(sets_.filter("n > 0"), scratch).collect()}
    prints = {r["c"]: r["fp"] & (2**64 - 1) for r in sets_.filter("n > 0").collect()}
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3}
    assert got and got <= near
    # what near_copies() links includes what the index finds and the sets confirm
    calls = []
    real = simhash.fingerprint_pairs
    try:
        simhash.fingerprint_pairs = lambda *a: calls.append(1) or real(*a)
        corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").count()
    finally:
        simhash.fingerprint_pairs = real
    assert calls
