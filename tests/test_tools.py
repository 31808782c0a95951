import json
import shutil

import pytest
from gistmill.functions import python as P
from gistmill.plans import audit, compress, tools
from gistmill.sources import readers
from pyspark.sql import functions as F


def test_model_tokens_and_likeness(spark):
    import tiktoken

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    df = spark.createDataFrame([("hello wörld, this is 1 test", "hello world"), ("", "x"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(P.model_token_count(path)("a")).collect()]
    import base64

    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.SPLIT, mergeable_ranks=ranks, special_tokens={})
    assert got == [len(enc.encode_ordinary("hello wörld, this is 1 test")), 0, None]
    assert [r[0] for r in df.select(P.likeness("a", "a")).collect()] == [1.0, 1.0, None]
    assert [r["embedding"] for r in P.embedded(df, lambda: lambda ts: [[float(len(t))] for t in ts], "b").collect()] == [[11.0], [1.0], [0.0]]


def test_tool_outputs_only_shrink(spark):
    rows = json.dumps([{"id": i, "v": "same"} for i in range(100)])
    got = {r["id"]: r["new_text"] for r in tools.compress_tool_outputs(spark.createDataFrame([(1, rows), (2, "tiny"), (3, None)], "id int, text string")).collect()}
    assert len(got[1]) < len(rows) and got[2] == "tiny" and set(got) == {1, 2}
    assert len(tools.compress_text(spark, rows)) < len(rows)


def test_images(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000010000000080000")
    p = tools.image_plans(spark.createDataFrame([(1, "openai", png, None), (2, "claude", b"zz", "auto")], "id int, provider string, data binary, detail string"))
    s = tools.image_stats(p).first()
    assert (s["n_images"], s["n_known"], s["n_reduced"]) == (2, 1, 1) and s["tokens_after"] <= s["tokens_before"]


def test_rules_file_is_idempotent(tmp_path):
    f = tmp_path / "rules.md"
    f.write_bytes(b"# Mine\r\nkeep\r\n")
    assert "+" in tools.apply_rules("## R\n\n- a\n", str(f)) and f.read_bytes() == b"# Mine\r\nkeep\r\n"
    tools.apply_rules("## R\n\n- a\n", str(f), dry_run=False)
    once = f.read_bytes()
    assert b"- a\r\n" in once and tools.apply_rules("## R\n\n- a\n", str(f), dry_run=False) == "" and f.read_bytes() == once
    f.write_text(tools.BEGIN)
    with pytest.raises(ValueError):
        tools.apply_rules("x", str(f))


def test_findings_from_session_files(spark, tmp_path):
    rows = [("tool_call", {"tool": "t", "status": "error"})] * 3 + [("tool_call", {"tool": "u"}), ("outcome", {"status": "corrected", "detail": {"fix": "v"}})] * 2 + [("compress", {"ratio": 0.01, "orig_tokens": 2000})] * 2
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"ts": i, "session_id": "s", "kind": k, "payload": p}) for i, (k, p) in enumerate(rows)))
    e = readers.read_sessions(spark, str(tmp_path)).withColumn("payload", F.col("payload").withField("correction", readers.correction_text()))
    got = {r["kind"]: (r["evidence_count"], r["confidence"]) for r in audit.findings(e).collect()}
    assert got == {"repeated-tool-failure": (3, 0.5), "user-correction": (2, 0.4), "inefficient-compression": (2, 0.4)}
    block = audit.rules_block(audit.findings(e)).first()["block"]
    assert block.startswith("## Learned rules\n\n- Before a call of `t`") and "Prefer v over `u`." in block


def test_streams(spark, tmp_path):
    from gistmill.streaming import events

    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in")
    src = events.read(spark, str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = events.run(events.with_previous(src), "prev", "append", str(tmp_path / "c")).toPandas()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = spark.sql("select event_id, lag(event_type) over (partition by user_id order by ts, event_id) as previous from parquet.`/root/testdata/sf0.001/events.parquet`").toPandas()
    both = got.merge(want, on="event_id")
    assert len(both) == len(want) and (both["previous_x"].fillna("") == both["previous_y"].fillna("")).all()


def test_registry_takes_new_compressors(spark):
    upper = ("shout", lambda b, c: b.select("block_id", F.lit("!").alias("new_text"), F.expr("cast(array() as array<struct<hash: string, original: string>>)").alias("dropped")))
    c = compress.Config(min_bytes=0, registry={"text": upper})
    b = spark.createDataFrame([("1", "some words of prose", None)], "block_id string, text string, query string")
    r = compress.compress_blocks(b, c).first()
    assert (r["compressor"], r["new_text"], r["changed"]) == ("shout", "!", True)
    assert not compress.compress_blocks(b, compress.Config(min_bytes=0, compressors=("x",))).first()["changed"]
