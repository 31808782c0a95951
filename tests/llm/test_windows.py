import re
from collections import Counter

import numpy as np
from gistmill.llm import decontaminate


def shingles(t):
    w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
    return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def best(doc, item):
    """Weighted similarity of the best window of the item's size, by looking at every start."""
    d, i = shingles(doc), shingles(item)
    out, c = 0, Counter(i)
    for start in range(1 - len(i), len(d)):
        w = d[max(0, start) : start + len(i)]
        both = sum((Counter(w) & c).values())
        out = max(out, both / (len(w) + len(i) - both))
    return out


def test_windows_at_all_starts(spark):
    rng = np.random.default_rng(3)
    word = lambda n, v=10_000: [f"w{x}" for x in rng.integers(0, v, n)]
    items = [word(int(n)) for n in (3, 5, 9, 30, 45, 60, 90)] + [["a", "b", "c"] * 15]
    docs = []
    for it in items:
        h = len(it) // 2
        for body in (it, it[h:] + it[:h], it[h:] + word(1) + it[:h], it[len(it) // 6 :], it[: -len(it) // 6], it[:h] + word(3) + it[h:], it[h:], it[:h] + it):
            docs += [body, word(7) + body + word(20), word(2) + body]
    docs = {i: " ".join(d) for i, d in enumerate(docs)}
    bench = {i: " ".join(d) for i, d in enumerate(items)}
    got = decontaminate.contamination(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(bench.items()), "item_id long, text string"))
    want = {d: ",".join(str(i) for i, it in bench.items() if best(t, it) >= 0.8) for d, t in docs.items()}
    assert {r["doc_id"]: r["items"] for r in got.collect()} == want


def test_halves_in_another_order(spark):
    w = [f"w{i}" for i in range(60)]
    doc = " ".join(["x", "y", *w[30:], *w[:30], "z", "u"])
    got = decontaminate.contamination(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string"))
    assert got.first()["items"] == "7"
