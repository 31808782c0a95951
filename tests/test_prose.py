from conftest import SF
from gistmill.functions.markers import text_marker
from gistmill.functions.text import content_hash
from gistmill.operators import prose
from gistmill.plans import compress
from pyspark.sql import Window
from pyspark.sql import functions as F

FENCED = "Some words. More words here! And so on? Yes.\n\n```\na. b. c.\n\nd. e\n\n``` x ``` y\n\nThe end. Of it. All."
ODD = ["", " ", "\n\n", "one", FENCED, FENCED + "\n\n```", "- item. two. three. four. five. six", "1.\u00a0no list. one. two. three. four. five", "İstanbul KELVIN \u212a x. ÉA aB a_b é1. Ünï abc. x\u2003y.\u2003z. a.\x1cb. c!\x85d? e.\u200bf" * 3,
    "  # head. a. b\n\n   > q. r\n\nA b c. " + "The same words again and again. " * 12 + "Zebras graze. the of and. ", "Short. " * 40 + "\n\n\n\n" + "Word " * 60 + ". " + "x. " * 9, None]


def by_windows(blocks, ratio=0.2, queries=None):
    """What paragraphs(), scored() and chosen() say, put together by windows and groups."""
    parts = prose.paragraphs(blocks)
    rows = prose.chosen(prose.scored(parts, queries), ratio)
    by = Window.partitionBy("block_id", "p_idx").orderBy("s_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.when(F.col("keep"), F.col("s_idx")).otherwise(F.sum(F.col("keep").cast("int")).over(by) - 1_000_000))
    runs = rows.groupBy("block_id", "p_idx", "_run").agg(F.array_sort(F.collect_list(F.struct("s_idx", "sentence"))).alias("ss"), F.first("keep").alias("keep"))
    lost = F.when(~F.col("keep"), F.array_join("ss.sentence", "\n"))
    runs = runs.withColumns({"at": F.get("ss.s_idx", F.lit(0)), "original": lost, "t": F.when(F.col("keep"), F.get("ss.sentence", F.lit(0))).otherwise(text_marker(F.col("ss.sentence"), "prose-elided"))})
    made = runs.groupBy("block_id", "p_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), " ").alias("made"))
    gone = runs.filter("original is not null").groupBy("block_id").agg(F.collect_list(F.struct(content_hash(F.col("original")).alias("hash"), "original")).alias("d"))
    whole = parts.join(made, ["block_id", "p_idx"], "left")
    t = F.when(F.col("structural"), F.col("text")).otherwise(F.coalesce("made", F.lit("")))
    text = whole.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_idx", t.alias("t")))), lambda x: x["t"]), "\n\n").alias("t"), F.max("made").isNotNull().alias("any"))
    out = blocks.select("block_id", "text").join(text, "block_id").join(gone, "block_id", "left")
    better = F.col("any") & (F.length("t") < F.length("text"))
    none = F.expr("cast(array() as array<struct<hash: string, original: string>>)")
    return out.select("block_id", F.when(better, F.col("t")).otherwise(F.col("text")).alias("new_text"), F.when(better, F.coalesce("d", none)).otherwise(none).alias("dropped"))


def rows(df):
    return {r["block_id"]: (r["new_text"], sorted(map(tuple, r["dropped"]))) for r in df.collect()}


def test_texts_are_cut_as_paragraphs_scores_and_choice_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("int").alias("block_id"), "text").limit(60)
    blocks = docs.unionByName(spark.createDataFrame(list(enumerate(ODD, 1_000_000)), "block_id int, text string"))
    asked = blocks.select("block_id", F.when(F.col("block_id") % 2 == 0, "zebras graze again again?").alias("query"))
    for ratio, queries in ((0.2, None), (0.5, asked)):
        got, want = rows(prose.compress(blocks, ratio, queries)), rows(by_windows(blocks, ratio, queries))
        assert got.keys() == want.keys()
        for i, x in want.items():
            assert got[i] == x, i
        assert sum(bool(d) for _, d in got.values()) > 30


def test_no_text_is_shuffled(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "block_id int, text string")
    assert "Exchange" not in prose.compress(df, 0.2, F.lit("x"))._jdf.queryExecution().executedPlan().toString()
    assert {r["content_type"]: r["n"] for r in compress.compress_documents(df.withColumnRenamed("block_id", "doc_id")).groupBy("content_type").agg(F.count("*").alias("n")).collect()}["text"] > 3
