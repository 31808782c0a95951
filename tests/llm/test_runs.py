import numpy as np
from gistmill.llm import lines


def whole_runs(texts, min_bytes):
    """Runs of any number of lines that also start earlier, by looking at every one."""
    seen, gone = set(), {}
    ls = [(d, t.split("\n")) for d, t in texts]
    for d, ll in ls:
        for i in range(len(ll)):
            for e in range(i + 1, len(ll) + 1):
                w = tuple(ll[i:e])
                if w in seen and sum(len(x.encode()) for x in w) + len(w) - 1 >= min_bytes:
                    gone.setdefault(d, set()).update(range(i, e))
                seen.add(w)
    return {d: "\n".join(x for i, x in enumerate(ll) if i not in gone.get(d, ())) for d, ll in ls}


def test_op2_removes_whole_runs(spark):
    rng = np.random.default_rng(4)
    vocab = ["", "a", "short", "fifteen bytes..", "a line of some length here", "another line, rather longer than the first one", "é" * 20]
    texts = [(i, "\n".join(vocab[j] for j in rng.integers(0, 7, rng.integers(1, 14)))) for i in range(60)]
    texts += [(60, "\n".join(["", *"abc"] * 30)), (61, "\n".join(["x", *["", *"abc"] * 30])), (62, "q\n" * 70), (63, "\n" * 90), (64, "\n" * 39), (65, "\n" * 45)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for least in (40, 17, 1):
        assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, least).collect()} == whole_runs(texts, least)


def test_op2_title_goes_with_its_paragraph(spark):
    page, three = "Title\n\n" + "a long paragraph " * 5, "fifteen bytes 1\nfifteen bytes 2\nfifteen bytes 3"
    df = spark.createDataFrame([(1, page), (2, page), (3, three), (4, three)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()} == {1: page, 2: "", 3: three, 4: ""}
