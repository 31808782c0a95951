"""What the operators share: tables cut from their lineage, document keys, packing of word hashes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null id inside the operators; it sorts before every id.
NO_ID = -(2**63)
#: Session settings that the operators put in the place of Spark's defaults (never of a value that the user chose).
#: Batches of texts that go to Python are bounded by bytes, as a batch counted in rows grows with the texts.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}
#: Removes the shuffle files of a statement when it ends: what it wrote stands in the shared folder.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Where that is unset, a master that runs on this machine alone gets a temporary folder, as in tests; on a cluster
    executors would each write to a disk of their own, so ValueError is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/gistmill-{uuid.uuid4().hex}"
        self.count = 0
        for key, (default, value) in SETTINGS.items():
            if spark.conf.get(key, default) == default:
                spark.conf.set(key, value)
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that save() wrote and that no later plan reads."""
        self._delete(df.scratch_path)

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # at exit the JVM may be gone
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is not None:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, _did, _sub) of the rows of docs, whose columns are packed in row, and the distinct (_did, _sub, _text).

    Packed columns can't clash with inner names, whatever they are called. _did is doc_id with nulls as NO_ID, a null text
    is empty. _sub tells apart rows that share a doc_id: rows with equal texts are the same document and share a _sub;
    others are numbered in the order of their texts. It is 0 for all where no id repeats, which a scan of the ids shows;
    only otherwise are the texts sorted by id.
    """
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    repeats = docs.groupBy(did.alias("k")).count().filter("count > 1").limit(1).count() > 0
    if repeats:
        sub = F.dense_rank().over(Window.partitionBy("_did").orderBy("_text")) - 1
        rows = docs.select(row, did.alias("_did"), whole_text(F.col("text")).alias("_text")).withColumn("_sub", sub.cast("int"))
        distinct = rows.select("_did", "_sub", "_text").distinct()
        rows = rows.select("row", "_did", "_sub")
    else:
        rows = docs.select(row, did.alias("_did"), F.lit(0).alias("_sub"))
        distinct = docs.select(did.alias("_did"), F.lit(0).alias("_sub"), whole_text(F.col("text")).alias("_text"))
    distinct.repeats = repeats  # whether rows can be more than the distinct documents
    return rows, distinct


def whole_text(text) -> F.Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def columns_of(docs: DataFrame, **replaced: F.Column) -> list[F.Column]:
    """The columns of docs out of row, those named in `replaced` with their new values."""
    return [replaced.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def merged(ranges) -> F.Column:
    """Sorted ranges {s, e} (end exclusive) of an array, with those that meet or overlap joined."""
    empty = F.expr("cast(array() as array<struct<s: bigint, e: bigint>>)")

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        )

    return F.aggregate(F.array_sort(ranges), empty, add)
