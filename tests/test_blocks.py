"""Blocks whose ids repeat, messages put together again, anchors of queries, detection of every class."""

import json

from gistmill.functions import detect, text
from gistmill.operators import arrays, markup, search, tabular
from gistmill.plans import compress
from pyspark.sql import functions as F

LONG = "The quick brown fox jumps over the lazy dog. It was late in May. Nobody saw the bear near the river. " * 12
OTHER = "Rain fell on the harbour all night long. The boats stayed in. A cat slept beneath the warm stove. " * 12


def test_repeated_ids_give_one_row_each(spark):
    df = spark.createDataFrame([(1, LONG), (1, OTHER), (2, LONG), (None, OTHER), (2, LONG)], "doc_id long, text string")
    got = compress.compress_documents(df).collect()
    assert len(got) == 5
    for r in got:
        own = set(r["text"].split(". "))
        kept = [x for x in r["new_text"].split("\n")[0].split(". ") if x and "ccr" not in x]
        assert r["changed"] and any(k.rstrip(".") in " ".join(own) for k in kept)
        assert ("fox" in r["new_text"] or "bear" in r["new_text"]) == (r["text"] == LONG)


def test_messages_are_put_together_again(spark):
    items = json.dumps([{"n": i, "v": "same"} for i in range(60)])
    rows = [
        ("a", 0, "user", "Short.", None), ("a", 1, "tool", items, None), ("a", 1, "tool", items, None), (None, 1, "tool", LONG, None), (None, None, None, None, None),
        ("b", 0, "user", None, [("text", "hello", None), ("tool_result", None, items), ("image", None, None)]),
    ]
    m = spark.createDataFrame(rows, "conv_id string, msg_index long, role string, content string, blocks array<struct<type: string, text: string, content: string>>")
    c = compress.compress_messages(m)
    out = compress.rebuilt(m, c).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == set(m.columns)
    new = {r["text"]: r["new_text"] for r in c.collect()}
    assert len(new[items]) < len(items) and len(new[LONG]) < len(LONG)
    key = lambda r: (str(r[0]), str(r[1]))
    for got, was in zip(sorted(out, key=key), sorted(rows, key=key), strict=True):
        assert got["content"] == (None if was[3] is None else new[was[3]])
        want = was[4] and [(t, new.get(x, x), new.get(y, y)) for t, x, y in was[4]]
        assert (got["blocks"] and [tuple(b) for b in got["blocks"]]) == want


def test_stop_words_anchor_nothing(spark):
    items = [{"id": i, "note": f"the state of item {i} is a plain one"} for i in range(100)] + [{"id": 100, "note": "a zebra"}]
    items[50] = {"id": 50, "note": "here the zebra stands"}
    query = "What is the status of a zebra?"
    some, lost = markup.crushed(json.dumps(items), query)
    none, _ = markup.crushed(json.dumps(items))
    assert "here the zebra stands" in some and len(some) < len(none) + 100 and lost
    assert len(json.loads(markup.crushed(json.dumps(items), "what is the")[0])) > 50  # nothing but stop words: all of them anchor
    got = spark.createDataFrame([(query,), ("is the",), ("",)], "q string").select(text.anchors(F.col("q")).alias("a")).collect()
    assert [r["a"] for r in got] == [["status", "zebra"], ["is", "the"], []]
    rows = spark.createDataFrame([("the of is",), ("zebra",)], "t string").select(arrays.matches_query(F.col("t"), F.lit(query)).alias("m")).collect()
    assert [r["m"] for r in rows] == [False, True]


def test_cells_take_the_delimiter_with_most_columns(spark):
    tables = {"a,b;c\n1,2;3\n": [["a", "b;c"], ["1", "2;3"]], "a;b,c;d\n1;2,3;4": [["a", "b,c", "d"], ["1", "2,3", "4"]], "a|b\n|": [["a", "b"], ["", ""]], "a\tb\n1\t2": [["a", "b"], ["1", "2"]], "a,b\n1": None, "x\ny": None}
    df = spark.createDataFrame([(t,) for t in tables], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", tabular.cells(text.split_lines(F.col("t"))).alias("c")).collect()}
    assert got == tables


def test_hits_are_parsed_as_the_pattern_says(spark):
    lines = ["a/b.py:3:x = 1", "C:\\d\\e.c:14:int x;", "a-b.py-7-ctx", "no hit", ":3:x", "a\0b:3:y\0z", "p:1:\0", "f.py:9:"]
    got = search.hits(spark.createDataFrame([(1, "\n".join(lines))], "block_id long, text string")).orderBy("idx").collect()
    assert [(r["path"], r["lineno"], r["content"], r["is_match"]) for r in got] == [
        ("a/b.py", 3, "x = 1", True), ("C:\\d\\e.c", 14, "int x;", True), ("a-b.py", 7, "ctx", False), ("a\0b", 3, "y\0z", True), ("p", 1, "\0", True), ("f.py", 9, "", True),
    ]


CLASSES = {
    "json": '{"a": [1, 2, {"b": null}]}',
    "html": "<html><body><p>x</p></body></html>",
    "diff": "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b",
    "log": "2024-01-02 10:00:00 INFO start\n2024-01-02 10:00:01 ERROR stop\nplain",
    "csv": "a,b,c\n1,2,3\n4,5,6",
    "search": "10:def x\n11-  y\n12:z",
    "code": "def f(x):\n    return x == 1\nclass A:\n    import b\n    const = {};",
    "markdown": "# Title\n\n- one\n- two\n",
    "text": "Just some prose that says little.",
}


def test_every_class_is_detected(spark):
    df = spark.createDataFrame([(k, t) for k, t in CLASSES.items()] + [("text", None)], "want string, text string")
    assert all(r["want"] == r["detected"]["content_type"] for r in detect.detected(df).collect())
