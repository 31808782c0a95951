"""Streams of events: sessions, totals by window, originals seen once, outcomes matched to calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import content_hash

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The events table as a stream; ts becomes a timestamp, which watermarks ask for."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, value) of runs of a user's events no further apart than gap."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def totals(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) by tumbling window."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def once(originals: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """originals (ts, original) with hash, each content once within its time to live; state older than that goes."""
    return originals.withColumn("hash", content_hash(F.col("original"))).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["hash"])


class Previous(StatefulProcessor):
    """Keeps each user's last event, so that an event is returned with the one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event_type string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.sort_values(["ts", "event_id"])
            before = self.last.get()[0] if self.last.exists() else None
            prev = pdf["event_type"].shift(1)
            prev.iloc[0] = before
            self.last.update((pdf["event_type"].iloc[-1],))
            yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "event_type": pdf["event_type"], "previous": prev})

    def close(self) -> None:
        pass


def with_previous(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type, previous): each event with its user's event before it, across micro-batches. Needs the
    RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(Previous(), "user_id long, event_id long, event_type string, previous string", "append", "none")


def run(out: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream of that name over what is there now and returns its rows, read from Parquet that executors write beside
    the checkpoint, so no row passes through the driver. In complete mode the last batch stands for all before it."""
    spark, parts = out.sparkSession, {}

    def batch(df: DataFrame, n: int) -> None:
        at = "all" if mode == "complete" else n
        df.write.mode("overwrite").parquet(path := f"{checkpoint}-rows/{at}")
        parts[at] = path

    q = out.writeStream.foreachBatch(batch).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(*parts.values()) if parts else spark.createDataFrame([], out.schema)


def compress_arriving(blocks: DataFrame, path: str, checkpoint: str, config=None):
    """Starts a stream that compresses arriving blocks (block_id, text, query) into Parquet. Markers are content hashes, so a
    batch that is run again writes equal rows."""
    from ..plans.compress import compress_blocks

    def batch(df: DataFrame, n: int) -> None:
        compress_blocks(df, config).select("block_id", "content_type", "compressor", "orig_tokens", "new_tokens", "new_text", "dropped").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return blocks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
