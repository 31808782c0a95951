from datetime import datetime

import pytest
from gistmill.streaming import events

ROWS = [(1, datetime(2024, 1, 1, 10, 0), 1, "click", 1.0, "{}"), (2, datetime(2024, 1, 1, 10, 20), 1, "view", 2.0, "{}"), (3, datetime(2024, 1, 1, 12, 0), 1, "view", 4.0, "{}"), (4, datetime(2024, 1, 1, 12, 0), 2, "click", 8.0, "{}")]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_run_returns_rows_that_executors_wrote(spark, tmp_path, mode):
    for i, part in enumerate((ROWS[:2], ROWS[2:], [])):
        spark.createDataFrame(part, events.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    # a file a batch
    src = spark.readStream.schema(events.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in[01]")
    out = src.withColumn("ts", src.ts.cast("timestamp"))
    got = events.run(events.sessions(out) if mode == "complete" else out.select("event_id"), f"s_{mode}", mode, f"{tmp_path}/state")
    want = [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 8.0)] if mode == "complete" else [(r[0],) for r in ROWS]
    assert sorted(map(tuple, (got.select("user_id", "n", "value") if mode == "complete" else got).collect())) == want
    # rows are files that were written beside the checkpoint, not a table of the driver's memory
    assert all("/state-rows/" in f for f in got.inputFiles()) and got.inputFiles()


def test_run_of_an_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema("a int").parquet(f"{tmp_path}/in")
    got = events.run(src, "nothing", "append", f"{tmp_path}/state")
    assert got.columns == ["a"] and got.count() == 0
