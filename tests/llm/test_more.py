import hashlib
import math
import re
from collections import Counter
from itertools import product
from urllib.parse import urljoin, urlsplit

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from gistmill.llm import decontaminate, langid, lines, quality, secrets, simhash, substrings, urls
from gistmill.llm.common import Scratch, scratch_root

CLASH = "doc_id long, text string, runs string, _items string, _did string, _sub string, _text string, row string, found string, k1 string, c string, pattern string, first string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefghijk") for r in rows], CLASH)


def test_columns_that_clash_come_back_as_they_were(spark):
    t = "a long line that is repeated, over forty bytes in all"
    df = clashing(spark, [(1, t), (2, t), (2, "other " * 30), (None, None), (3, "")])
    bench = spark.createDataFrame([(1, t)], "item_id long, text string")
    for out in (lines.dedup_lines(df), decontaminate.contamination(df, bench), simhash.first_copies(df), quality.kept_rows(df)):
        assert out.columns[: len(df.columns)] == df.columns
        assert all(tuple(r)[2:13] == tuple("abcdefghijk") for r in out.collect())
    assert lines.dedup_lines(df).count() == 5 == decontaminate.contamination(df, bench).count()


def test_scratch_root_is_the_shared_folder(spark, tmp_path):
    class Session:
        def __init__(self, root, master):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": root}, self
            self.master, self.getConf = master, lambda: {}

    assert scratch_root(Session(f"file://{tmp_path}/shared/", "yarn")) == f"file://{tmp_path}/shared"
    assert scratch_root(Session(None, "local[4]")).startswith("file:///")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            scratch_root(Session(None, master))


def test_op1_chains_go_through_rows_without_id(spark):
    words = [f"w{i}" for i in range(400)]
    near = {}
    for k in range(400):
        t = " ".join([*words[:k], "x", *words[k + 1 :]])
        near[t] = simhash.fingerprint(t.encode())
    chain = next((a, b, c) for a, b, c in product(near, near, near) if (near[a] ^ near[b]).bit_count() == 2 == (near[b] ^ near[c]).bit_count() and (near[a] ^ near[c]).bit_count() == 4)
    df = spark.createDataFrame([(1, chain[0]), (None, chain[1]), (2, chain[2]), (3, "all alone"), (None, "no one near")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == [("1", "1"), ("2", "1"), ("3", "3"), ("None", "1"), ("None", "None")]


def test_op1_tally_drops_pairs_that_share_too_little(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 1, base ^ (1 << 9) ^ (1 << 30), base ^ (1 << 9) ^ (1 << 30) ^ (1 << 50), base ^ 7]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), Scratch(spark)).collect()}
    assert got == {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}


def test_pipeline_keeps_one_row_of_a_group_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(5, a, "x"), (None, a, "x"), (4, a + " tail", "x"), (4, b, "x"), (4, b, "x"), (4, b, "y"), (None, c, "x"), (None, c, "x"), (7, b, "x")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"]) == [(4, a + " tail"), (4, b)]
    assert [(r["doc_id"], r["text"]) for r in got if r["doc_id"] is None] == [(None, c)]


def test_op3_und_only_without_letters(spark):
    f = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    for t in ("zzzz qqqq", "x", "中文", "Привет"):
        assert f.predict(t)[0] in f.languages and 0 <= f.predict(t)[1] <= 1
    assert [f.predict(t) for t in (None, "", "12 .", " \n")] == [("und", 0.0)] * 4


def test_op3_learns_more_than_64_languages(spark):
    alphabet = [f"{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in range(90)]
    rows = [(1000 * k + i, " ".join([x * 3] * 5), f"l{k:02}") for k, x in enumerate(alphabet) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 540 and all(r["lang"] == r["lang_pred"] for r in got)


def test_op3_chunks_hash_each_ngram_once(monkeypatch):
    t = "some words, with Ünïcode and 12 digits " * 30
    whole = Counter(np.concatenate(list(langid.ngram_hashes(t))).tolist())
    for size in (1, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert Counter(np.concatenate(list(langid.ngram_hashes(t))).tolist()) == whole


def test_op4_pages_without_a_host_stay_apart(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "about:blank", link.format("http://a.com/en/1")), (2, "foo", ""), (3, "", ""), (4, "bar/baz", link.format("x")), (5, "http://q.io/", link.format("http://a.com/en/?a=1&amp;b=2")), (6, "http://q.io", "")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block"}


def name(url):
    u = urlsplit(url)
    return u.netloc.lower() + (u.path or "/") + (f"?{u.query}" if u.query else "")


def test_op4_equals_union_find_on_generated_pages(spark):
    rng = np.random.default_rng(9)
    hosts = ["a.com", "b.org", "example.com", "x.net", "sub.example.net", "q.io"]
    paths = ["/", "/en/1", "/en/7", "/de/8", "/es/2", "/fr/3?p=1", "/z/w"]
    page = lambda: f"http://{hosts[rng.integers(0, 6)]}{paths[rng.integers(0, 7)]}"
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', "<meta http-equiv=refresh content='3;URL=\"{}\"'>"]
    rows, edges = [], []
    for i in range(90):
        url, target = page() + f"#{i}", [page(), "../up", "next", "/root", f"//{hosts[i % 6]}/en/5"][rng.integers(0, 5)]
        html = forms[i % 4].format(target) if rng.random() < 0.35 else "<p>none</p>"
        rows.append((i, url, html))
        if "none" not in html:
            edges.append((name(url), name(urljoin(url, target))))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)

    def rule(node):
        host, _, rest = node.partition("/")
        path = "/" + rest.split("?")[0]
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    bad = {find(n) for e in edges for n in e if rule(n) == "block"}
    want = {i: rule(name(u)) or ("block" if find(name(u)) in bad else "allow") for i, u, _ in rows}
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == want and set(want.values()) == {"block", "allow"}
    assert any(rule(name(u)) is None and want[i] == "block" for i, u, _ in rows)


def dearest(value, rank):
    """The least cost over all segmentations, by every span from every start."""
    keys = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
    sizes = lambda c: 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100
    leet = {"@": "a", "4": "a", "8": "b", "3": "e", "0": "o", "$": "s", "5": "s", "7": "t", "!": "i"}

    def costs(span):
        low, n = span.lower(), len(span)
        if n == 1:
            yield math.log10(sizes(span))
            return
        if n > 2 and len(set(span)) == 1:
            yield math.log10(sizes(span[0]) * n * 2)
        if n > 2 and all(any(abs(k.find(a) - k.find(b)) == 1 and a in k and b in k for k in keys) for a, b in zip(low, low[1:])):
            yield math.log10(50 * 2) + (n - 1) * math.log10(2)
        if re.fullmatch(r"(19|20)\d\d", span):
            yield math.log10(119 * 2)
        if re.fullmatch(r"(19|20)\d\d[-/._]?(0[1-9]|1[0-2])[-/._]?(0[1-9]|[12]\d|3[01])|(0[1-9]|[12]\d|3[01])[-/._]?(0[1-9]|1[0-2])[-/._]?(19|20)\d\d", span) and n in (8, 10):
            yield math.log10(365 * 119 * 2)
        for one in "il":
            for use in (True, False):
                word = "".join(({**leet, "1": one}.get(c, c) if use else c) for c in low)
                if n <= 16 and word in rank:
                    up = sum(c.isupper() for c in span)
                    caps = 1 if up == 0 else 2 if up == n or (up == 1 and span[0].isupper()) else 2 + sum(math.comb(n, k) for k in range(1, min(up, n - up) + 1))
                    yield math.log10(rank[word] * caps * 2) + sum(a != b for a, b in zip(word, low)) * math.log10(2)

    best = [0.0]
    for i in range(1, len(value) + 1):
        best.append(min(best[j] + c for j in range(i) for c in costs(value[j:i])))
    return best[-1]


def test_op6_cost_is_the_least_over_all_segmentations():
    rank = secrets.RANK | {"rewe": 400, "wert": 500, "liverpool": 600}
    rng = np.random.default_rng(6)
    parts = ["pass", "P@ssw0rd", "2024", "19991231", "aaaa", "qwertyuiop", "l1verpool", "Liverpool", "LoVe", "x", "9", "-", "é", "zzzzzzzzz", "rewerewe", "asdf", "1111", "t35t", "20000000"]
    values = ["".join(parts[k] for k in rng.integers(0, len(parts), 4)) for _ in range(150)] + ["a" * 60, "password" + "d" * 40, "qw" * 30, "abc" * 15]
    for v in values:
        assert abs(secrets.guess_cost(v, rank) - dearest(v, rank)) < 1e-9, v
    for v in ("P@ssw0rd!2024", "liverpool2019"):
        assert secrets.guess_cost(v, rank) < secrets.STRONG


def test_op6_learns_the_corpus_words(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha, ALPHA gamma zzzz"), (2, "beta x delta"), (3, None)], "doc_id long, text string")
    rank = secrets.learn_words(df, 3)
    n = len(secrets.RANK)
    assert {w: r - n for w, r in rank.items() if w not in secrets.RANK} == {"alpha": 1, "beta": 2, "delta": 3}
    assert rank | secrets.RANK == rank


def test_op6_base_spans_equal_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    kinds = ["assign", "access", "hex"]

    def base(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) >= 6]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
        return [f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(out)]

    for r in secrets.digest(secrets.scan(docs)).collect():
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w.startswith(k) for w in want) for k in kinds]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("guess")] == want


@pytest.mark.parametrize("width", [1, 8, 20])
def test_op7_multikey_quicksort_sorts(width):
    rng = np.random.default_rng(width)
    words, group = rng.integers(0, 3, (500, width)).astype(np.uint64), np.sort(rng.integers(0, 9, 500))
    got = multikey = substrings.multikey_quicksort(words, group)
    rows = [(int(group[k]), *words[k].tolist()) for k in multikey.tolist()]
    assert rows == sorted(rows) and sorted(got.tolist()) == list(range(500))


def votes_of(p):
    return [p // 3**k % 3 for k in range(quality.RULES)]


def test_op8_verdicts_equal_a_plain_fit(spark):
    """Expectation-maximisation written out row by row."""
    rows = quality.measured(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    v = [votes_of(r["pattern"]) for r in rows]
    n, rules = len(v), quality.RULES
    good, bad, prior, weight = [quality.TRUST_GOOD] * rules, [quality.TRUST_BAD] * rules, 0.8, quality.WEIGHT * len(v)
    for _ in range(100):
        post = []
        for x in v:
            a, b = prior, 1 - prior
            for k, vote in enumerate(x):
                if vote != quality.ABSTAIN:
                    a *= good[k] if vote == quality.GOOD else 1 - good[k]
                    b *= bad[k] if vote == quality.BAD else 1 - bad[k]
            post.append(a / (a + b))
        said = [[i for i in range(n) if v[i][k] != quality.ABSTAIN] for k in range(rules)]
        good = [(sum(post[i] for i in said[k] if v[i][k] == quality.GOOD) + quality.TRUST_GOOD * weight) / (sum(post[i] for i in said[k]) + weight) for k in range(rules)]
        bad = [(sum(1 - post[i] for i in said[k] if v[i][k] == quality.BAD) + quality.TRUST_BAD * weight) / (sum(1 - post[i] for i in said[k]) + weight) for k in range(rules)]
        prior = (sum(post) + 0.8 * weight) / (n + weight)
    want = {r["doc_id"]: p for r, p in zip(rows, post)}
    for r in quality.quality(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert abs(r["posterior"] - want[r["doc_id"]]) < 1e-6
        assert r["kept"] == (r["n_words"] >= 20 and 100 * r["n_repeat_words"] <= 30 * r["n_words"] and want[r["doc_id"]] >= 0.5)


def test_op8_estimates_move_with_the_data():
    word = lambda vs: sum(v * 3**k for k, v in enumerate(vs))
    good = word([1] * 8)
    odd = word([1, 0, 1, 1, 1, 1, 1, 1])  # one rule says bad
    often, seldom = (quality.estimate({good: 1000, odd: k, word([0] * 8): 50})[odd] for k in (500, 1))
    assert often > seldom


def test_op10_finds_items_by_blocks_alone(spark):
    """Items of one size that share no shingle with a window aren't needed to find those that do; equal items all come."""
    rng = np.random.default_rng(8)
    items = [" ".join(f"i{k}x{j}" for j in range(20)) for k in range(12)]
    docs = {k: " ".join([*(f"n{x}" for x in rng.integers(0, 999, 15)), items[k], "end"]) for k in range(12)}
    bench = spark.createDataFrame([*enumerate(items), (99, items[3])], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: r["items"] for r in got} == {k: "3,99" if k == 3 else str(k) for k in range(12)}
