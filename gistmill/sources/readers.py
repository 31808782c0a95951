"""Requests and session logs as DataFrames, tables of originals as Parquet."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import store

MESSAGE = "struct<role: string, content: string, tool_call_id: string>"
REQUEST = f"struct<id: string, model: string, messages: array<{MESSAGE}>>"
PAYLOAD = (
    "struct<tool: string, status: string, error: string, success: boolean, exit_code: int, ratio: double, orig_tokens: double, correction: string, instead: string, "
    "preferred: string, fix: string, rule: string, detail: struct<correction: string, instead: string, preferred: string, fix: string, rule: string>>"
)
EVENT = f"ts double, session_id string, kind string, payload {PAYLOAD}"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(id, messages) of request logs: files of one JSON array, one request, or a request a line.

    An array whose items are all messages is one request; a bare list of messages too. A request without an id is named by
    its place in its file. Files are read whole, as an array may span lines; lines that are no JSON fail the read.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    # an item a line, if each line is a whole object or array; built-in parsers overlook what follows a first value
    by_line = (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(r"^\s*(?:\{.*\}|\[.*\])\s*$") & F.try_parse_json(x).isNotNull())
    is_array = F.col("value").startswith("[") & ~by_line
    items = F.when(by_line, lines).when(is_array, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    all_messages = is_array & F.forall(items, lambda x: F.get_json_object(x, "$.role").isNotNull())
    items = F.when(all_messages, F.array("value")).otherwise(items)
    rows = files.select("file", F.posexplode(items).alias("i", "x")).withColumn("x", F.trim("x"))
    bare = F.from_json("x", f"array<{MESSAGE}>")
    full = F.from_json("x", REQUEST)
    made = rows.select("file", "i", F.when(F.col("x").startswith("["), F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("model"), bare.alias("messages"))).otherwise(full).alias("r"))
    checked = F.when(F.col("r.messages").isNotNull(), F.col("r.messages")).otherwise(F.raise_error(F.concat(F.lit("not a request: "), F.col("file"), F.lit(" item "), F.col("i").cast("string"))).cast(f"array<{MESSAGE}>"))
    return made.select(F.coalesce("r.id", F.concat(F.lit("req-"), F.col("i").cast("string"))).alias("id"), "r.model", checked.alias("messages"))


def messages_of(requests: DataFrame) -> DataFrame:
    """(conv_id, msg_index, role, content, tool_call_id)."""
    return requests.select(F.col("id").alias("conv_id"), F.posexplode("messages").alias("msg_index", "m")).select("conv_id", "msg_index", "m.*")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, seq, ts, kind, payload) of a folder of session logs, a JSON event a line; other lines are skipped and a
    missing folder has none. seq orders by file name, then line."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], f"session_id string, seq struct<file: string, line: int>, {EVENT.replace('session_id string, ', '')}")
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_name").alias("file"), F.split("value", "\n").alias("ls"))
    rows = files.select("file", F.posexplode("ls").alias("line", "x")).filter(F.trim("x").startswith("{"))
    parsed = rows.select("file", "line", F.from_json("x", EVENT).alias("e")).filter("e.kind is not null")
    return parsed.select(F.coalesce("e.session_id", F.lit("unknown")).alias("session_id"), F.struct("file", "line").alias("seq"), "e.ts", "e.kind", "e.payload")


def correction_text():
    """The first text of a payload's correction keys, in the payload and then in its detail."""
    keys = ("correction", "instead", "preferred", "fix", "rule")
    return F.coalesce(*[F.nullif(F.trim(F.col(f"payload.{d}{k}")), F.lit("")) for d in ("", "detail.") for k in keys])


def write_events(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines, a folder a session."""
    events.write.mode("append").partitionBy("session_id").json(path)


def save_originals(table: DataFrame, path: str) -> None:
    """Writes originals partitioned by the first two digits of their hash, so that a lookup reads a part of them."""
    table.withColumn("prefix", F.substring("hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def load_originals(spark: SparkSession, path: str) -> DataFrame:
    """Appended puts folded to one row for each hash."""
    return store.put(None, spark.read.parquet(path).select("original", "created_at"))


def add_memories(memory: DataFrame | None, new: DataFrame) -> DataFrame:
    """memory (id, content, metadata map, embedding, created_at) with new rows under fresh ids."""
    rows = new.select(F.expr("uuid()").alias("id"), "content", "metadata", "embedding", F.current_timestamp().alias("created_at"))
    return rows if memory is None else memory.unionByName(rows)


def delete_memories(memory: DataFrame, ids: DataFrame) -> DataFrame:
    return memory.join(ids.select("id"), "id", "left_anti")
