from gistmill.plans import audit, chat, store
from pyspark.sql import functions as F

ENTRY = "entry_id long, prompt string, response string, embedding array<double>, last_used long"


def test_puts_refresh_and_evict(spark):
    old = spark.createDataFrame([(1, "a", "old", [1.0, 0.0], 1), (2, "b", "b", [0.0, 1.0], 2), (3, "c", "c", [1.0, 1.0], 3)], ENTRY)
    new = spark.createDataFrame([(4, "a", "new", [1.0, 0.1], 5), (5, "d", "d", [0.0, 0.0], 6), (6, "e", "e", None, 7), (7, "f", "f", [2.0, 0.0], 8), (8, "f", "g", [3.0, 0.0], 8)], ENTRY)
    got = {r["prompt"]: (r["entry_id"], r["response"], r["embedding"], r["last_used"]) for r in store.cache_put(old, new, 3).collect()}
    assert got == {"a": (1, "new", [1.0, 0.0], 5), "c": (3, "c", [1.0, 1.0], 3), "f": (7, "g", [2.0, 0.0], 8)}
    assert store.cache_put(old.limit(0), new.limit(0), 3).count() == 0


def test_hits_refresh_what_they_were_served_from(spark):
    entries = spark.createDataFrame([(1, "enable it", "on", [1.0, 0.0], 1), (2, "other", "x", [0.0, 1.0], 2)], ENTRY)
    probes = spark.createDataFrame([(7, "disable it", [1.0, 0.0]), (8, "other", None)], "probe_id long, prompt string, embedding array<double>")
    hits = store.cache_lookup(probes, entries)
    assert [r["probe_id"] for r in hits.collect()] == [8]
    assert {r["probe_id"]: r["entry_id"] for r in store.cache_lookup(probes, entries, guarded=False).collect()} == {7: 1, 8: 2}
    assert {r["entry_id"]: r["last_used"] for r in store.touched(entries, hits, F.lit(9)).collect()} == {1: 1, 2: 9}


def test_cache_control_in_texts_lists_and_systems(spark):
    block = "array<struct<type: string, text: string, tool_use_id: string>>"
    rows = [
        (1, 0, "user", "x" * 9, None), (1, 1, "user", "short", None), (1, 2, "user", None, [("text", "y" * 9, None)]), (1, 3, "tool", None, [("text", "y" * 9, None), ("tool_result", "z" * 9, "t")]),
        (None, 0, "user", "n" * 9, None), (None, 1, "user", "n" * 9, None),
    ]
    m = spark.createDataFrame(rows, f"conv_id long, msg_index int, role string, content string, blocks {block}")
    s = spark.createDataFrame([(1, "small"), (None, "s" * 9), (2, None)], "conv_id long, system string")
    done, systems = chat.with_cache_control(m, s, chars=9, most=2)
    marks = {(r["conv_id"], r["msg_index"]): [b["cache_control"] and b["cache_control"]["type"] for b in r["blocks"] or []] for r in done.collect()}
    assert marks == {(1, 0): ["ephemeral"], (1, 1): [], (1, 2): ["ephemeral"], (1, 3): [None, None], (None, 0): [], (None, 1): ["ephemeral"]}
    texts = {(r["conv_id"], r["msg_index"]): (r["content"], [b["text"] for b in r["blocks"] or []]) for r in done.collect()}
    assert texts[1, 0] == (None, ["x" * 9]) and texts[1, 1] == ("short", []) and texts[None, 0] == ("n" * 9, [])
    assert {r["conv_id"]: (r["system"], r["blocks"] and r["blocks"][0]["text"]) for r in systems.collect()} == {1: ("small", None), None: (None, "s" * 9), 2: (None, None)}
    none, same = chat.with_cache_control(m.drop("blocks"), chars=9, most=0)
    assert same is None and none.filter("blocks is not null").count() == 0


def test_equal_instructions_make_equal_prefixes(spark):
    day = [f"Today is 2024-05-0{k}. Id 123e4567-e89b-12d3-a456-42661417400{k}" for k in (1, 2)]
    rows = [(k, i, r, t) for k, d in enumerate(day) for i, (r, t) in enumerate([("user", d), ("system", d), ("developer", None)])]
    out = chat.stable_prefix(spark.createDataFrame(rows, "conv_id long, msg_index int, role string, content string")).collect()
    got = {(r["conv_id"], r["place"]): (r["role"], r["content"]) for r in out}
    assert got[0, 0] == got[1, 0] == ("system", "Today is <TIMESTAMP>. Id <UUID>") and got[0, 1] == ("developer", None) and got[1, 2] == ("user", day[1])


def test_price_files_are_checked(spark, tmp_path):
    table = [tuple(r) for r in audit.prices(spark).collect()]
    file = tmp_path / "prices.json"
    assert [tuple(r) for r in audit.prices(spark, str(file)).collect()] == table
    file.write_text("no json\n{\"name\": \"half\", \"input\": 1}\n")
    assert [tuple(r) for r in audit.prices(spark, str(file)).collect()] == table
    file.write_text('{"name": "b", "input": 1, "output": 2}\nbroken\n{"name": "a", "input": 3.5, "output": 4}\n')
    assert [tuple(r) for r in audit.prices(spark, str(file)).collect()] == [(0, "a", 3.5, 4.0), (1, "b", 1.0, 2.0)]
