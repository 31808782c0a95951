"""Audits, costs, run totals and mined session rules, as joins and aggregates."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import compress as C

#: US dollars for a million tokens, in the order in which names are tried: fixed values.
PRICES = (
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4", 30.00, 60.00),
    ("gpt-3.5-turbo", 0.50, 1.50),
    ("claude-3-5-sonnet-latest", 3.00, 15.00),
    ("claude-3-5-sonnet-20241022", 3.00, 15.00),
    ("claude-3-5-haiku-latest", 0.80, 4.00),
    ("claude-3-haiku-20240307", 0.25, 1.25),
    ("gemini-1.5-flash", 0.075, 0.30),
    ("gemini-1.5-pro", 1.25, 5.00),
)
DEFAULT_MODEL = "gpt-4o"
#: Most lines of a price file, which is read on the driver.
PRICE_LINES = 100_000


def prices(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(ord, name, input, output) of the price table, or of a JSON-lines file with these columns.

    Lines of the file without a name or a price are left out; without ord, names stand in alphabetical order. A file that is
    missing or has no valid line gives the table.
    """
    schema = "ord int, name string, input double, output double"
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(PRICES)], schema)
    if not path:
        return table
    try:
        found = spark.read.schema(schema).json(path).filter("name is not null and input is not null and output is not null")
        rows = found.limit(PRICE_LINES + 1).collect()
    except (AnalysisException, Py4JJavaError):
        return table
    if len(rows) > PRICE_LINES:
        raise ValueError(f"{path} has over {PRICE_LINES} prices: it is no price table")
    if not rows:
        return table
    rows.sort(key=lambda r: (r["ord"] is None, r["ord"] or 0, r["name"]))
    return spark.createDataFrame([(i, r["name"], r["input"], r["output"]) for i, r in enumerate(rows)], schema)


def priced(runs: DataFrame, table: DataFrame, model: str = "model") -> DataFrame:
    """runs with price_name, input and output: of the equal name, else of the first that holds the model's name or is held by
    it, else of gpt-4o. Distinct models meet the price table, a bounded dimension; runs are joined to the outcome by name."""
    names = runs.select(F.coalesce(model, F.lit(DEFAULT_MODEL)).alias("_m")).distinct()
    t = F.broadcast(table)
    held = (F.col("_m") == F.col("name")) | F.contains(F.col("_m"), F.col("name")) | F.contains(F.col("name"), F.col("_m"))
    best = F.min(F.when(F.col("name").isNotNull(), F.struct((F.col("_m") != F.col("name")).alias("other"), "ord", "name", "input", "output")))
    found = names.join(t, held, "left").groupBy("_m").agg(best.alias("p"))
    fallback = table.filter(F.col("name") == DEFAULT_MODEL).select(F.struct(F.lit(True).alias("other"), "ord", "name", "input", "output").alias("q"))
    found = found.crossJoin(F.broadcast(fallback)).select("_m", F.coalesce("p", "q").alias("p"))
    out = runs.withColumn("_m", F.coalesce(model, F.lit(DEFAULT_MODEL))).join(found, "_m").drop("_m")
    return out.select(*runs.columns, F.col("p.name").alias("price_name"), F.col("p.input").alias("input"), F.col("p.output").alias("output"))


def cost(tokens: Column, per_million: Column) -> Column:
    return tokens / 1_000_000 * per_million


def audit(messages: DataFrame, table: DataFrame, model: str = DEFAULT_MODEL, c: C.Config | None = None) -> dict[str, DataFrame]:
    """rows (conv_id, tokens, ratio), by_type (conv_id, content_type, tokens) and total (tokens and dollars) of compressing
    messages."""
    done = C.compress_messages(messages, c)
    rows = C.totals(done, "conv_id")
    total = C.totals(done.withColumn("model", F.lit(model)), "model")
    p = priced(total, table)
    return {
        "rows": rows,
        "by_type": C.totals(done, "conv_id", "content_type"),
        "total": p.withColumns({"cost_before": cost(F.col("orig_tokens"), F.col("input")), "cost_after": cost(F.col("new_tokens"), F.col("input"))}).drop("input", "output", "price_name"),
    }


def run_totals(runs: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """(by, n_runs, orig_tokens, new_tokens, saved_tokens, ratio, saved_usd) of runs (orig_tokens, new_tokens, model)."""
    p = priced(runs, table)
    out = p.groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.sum("orig_tokens").alias("orig_tokens"), F.sum("new_tokens").alias("new_tokens"),
        F.sum(cost(F.col("orig_tokens") - F.col("new_tokens"), F.col("input"))).alias("saved_usd"),
    )
    o, n = F.col("orig_tokens"), F.col("new_tokens")
    return out.withColumns({"saved_tokens": o - n, "ratio": F.when(o > 0, 1 - n / o).otherwise(0.0)})


#: Statuses of failures, and where a correction's text may stand: fixed values.
FAILED = ("error", "failure", "failed", "fail", "fatal", "timeout", "rejected", "denied")
CORRECTED = (*FAILED, "corrected", "correction")
CORRECTION_KEYS = ("correction", "instead", "preferred", "fix", "rule")


def failed(p: Column) -> Column:
    """Whether a payload (struct with status, error, success, exit_code) tells of a failure."""
    status = F.lower(F.trim(F.coalesce(p["status"], F.lit(""))))
    return status.isin(*FAILED) | (F.coalesce(p["error"], F.lit("")) != "") | F.coalesce(~p["success"], F.lit(False)) | (F.coalesce(p["exit_code"], F.lit(0)) != 0)


def confidence(n: Column) -> Column:
    return F.bround(F.least(F.lit(0.95), n / (n + 3)), 2)


def findings(events: DataFrame, failures: int = 3, corrections: int = 2, inefficient: int = 2, low_ratio: float = 0.05, large: int = 1000) -> DataFrame:
    """(kind, subject, evidence_count, sessions, proposed_rule, confidence) mined from events (session_id, seq, kind, payload
    struct<tool, status, error, success, exit_code, ratio, orig_tokens, correction>).

    The event before in the session (a lag window) tells which call an outcome belongs to. Sessions are independent.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    fail = F.when(F.col("kind").isin("tool_call", "outcome"), failed(F.col("payload"))).otherwise(False)
    e = events.withColumn("_f", F.coalesce(fail, F.lit(False)))
    e = e.withColumn("_p", F.lag(F.struct("kind", "payload", F.col("_f").alias("counted"))).over(order))
    tool = lambda p: F.coalesce(F.nullif(p["tool"], F.lit("")), F.lit("unknown"))
    prev, own = F.col("_p.payload"), F.col("payload")
    after_call = F.col("_p.kind") == "tool_call"
    which = F.when((F.col("kind") == "tool_call") & F.col("_f"), tool(own)).when((F.col("kind") == "outcome") & F.col("_f") & after_call & ~F.col("_p.counted"), tool(prev))
    status = F.lower(F.trim(F.coalesce(own["status"], F.lit(""))))
    said = F.nullif(F.trim(F.coalesce(own["correction"], F.lit(""))), F.lit(""))
    action = F.when(after_call, F.concat(F.lit("`"), tool(prev), F.lit("`"))).otherwise("the `compress` settings of the session")
    corrected = (F.col("kind") == "outcome") & status.isin(*CORRECTED) & F.col("_p.kind").isin("tool_call", "compress")
    wasted = (F.col("kind") == "compress") & (own["ratio"] < low_ratio) & (own["orig_tokens"] >= large)
    rule_f = F.concat(F.lit("Before a call of `"), which, F.lit("`, see that its inputs, paths and permissions are in order: it has failed again and again."))
    rule_c = F.concat(F.lit("Prefer "), said, F.lit(" over "), action, F.lit("."))
    rule_w = F.lit(f"Payloads of {large} tokens and more shrink by less than {low_ratio:.0%}: give them other compression settings.")
    one = lambda cond, kind, subject, rule, least: F.when(cond, F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), rule.alias("rule"), F.lit(least).alias("least")))
    found = F.array_compact(F.array(
        one(which.isNotNull(), "repeated-tool-failure", which, rule_f, failures),
        one(corrected & said.isNotNull(), "user-correction", F.concat(action, F.lit(": "), said), rule_c, corrections),
        one(wasted, "inefficient-compression", F.lit("compress"), rule_w, inefficient),
    ))
    g = e.select("session_id", F.explode(found).alias("x")).groupBy("x").agg(F.count("*").alias("evidence_count"), F.array_sort(F.collect_set("session_id")).alias("sessions"))
    g = g.filter(F.col("evidence_count") >= F.col("x.least"))
    return g.select(F.col("x.kind").alias("kind"), F.col("x.subject").alias("subject"), "evidence_count", "sessions", F.col("x.rule").alias("proposed_rule"), confidence(F.col("evidence_count")).alias("confidence"))


def rules_block(found: DataFrame, heading: str = "## Learned rules") -> DataFrame:
    """(block): one Markdown text of the distinct rules, the surest first; a report of few findings."""
    best = Window.partitionBy("proposed_rule").orderBy(F.desc("confidence"), "kind", F.desc("evidence_count"))
    f = found.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    n = F.size("sessions")
    line = F.concat(F.lit("- "), F.col("proposed_rule"), F.lit(" (why: "), F.col("kind"), F.lit(" seen "), F.col("evidence_count").cast("string"), F.lit("x across "), n.cast("string"), F.when(n == 1, " session)").otherwise(" sessions)"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "kind", "proposed_rule", line.alias("line"))))
    return f.agg(F.when(F.count("*") > 0, F.concat(F.lit(heading + "\n\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), F.lit("\n"))).otherwise("").alias("block"))


def eval_fixtures(spark: SparkSession) -> DataFrame:
    """(name, content, must_keep): four payloads made here: orders with one error, cyclic prices with one anomaly, a service
    log with one error, a code search."""
    i = F.col("id")
    orders = spark.range(200).select(i, F.to_json(F.struct(i.alias("id"), F.when(i == 123, "error").otherwise("shipped").alias("status"), (i % 9 * 5 + 20).alias("amount"), F.lit("EUR").alias("currency"), F.when(i == 123, "card declined by issuer").otherwise("delivered on time").alias("detail"))).alias("x"))
    cyclic = spark.range(500).select(i, F.to_json(F.struct(i.alias("id"), F.concat(F.lit("part-"), i.cast("string")).alias("name"), F.when(i == 137, 99999).otherwise(10 + i % 37).alias("price"), F.when(i == 137, "error").otherwise("active").alias("status"), F.lit("stock item of the main warehouse").alias("desc"))).alias("x"))
    log = spark.range(122).select(i, F.when(i == 60, "2024-03-01 10:01:00 ERROR payments: upstream refused the connection").when(i == 121, "Summary: 1 failed, 120 passed").otherwise(F.concat(F.lit("2024-03-01 10:00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(" INFO payments: request served"))).alias("x"))
    code = spark.range(71).select(i, F.concat(F.lit("src/mod_"), (i % 12).cast("string"), F.lit(".py:"), (i * 7 + 3).cast("string"), F.lit(":    total = compute(total, "), i.cast("string"), F.lit(")")).alias("x"))
    def packed(df: DataFrame, name: str, sep: str, wrap: tuple[str, str], keep: list[str]) -> DataFrame:  # noqa: E306
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda r: r["x"]), sep)
        return df.agg(F.concat(F.lit(wrap[0]), body, F.lit(wrap[1])).alias("content")).select(F.lit(name).alias("name"), "content", F.array(*map(F.lit, keep)).alias("must_keep"))
    out = packed(orders, "json-orders", ",", ("[", "]"), ["card declined by issuer"])  # noqa: E305
    out = out.unionByName(packed(cyclic, "json-cyclic", ",", ("[", "]"), ["99999"]))
    out = out.unionByName(packed(log, "sre-log", "\n", ("", ""), ["upstream refused the connection", "1 failed"]))
    return out.unionByName(packed(code, "code-search", "\n", ("", ""), ["src/mod_3.py"]))


def evaluate(fixtures: DataFrame, c: C.Config | None = None) -> DataFrame:
    """(name, orig_tokens, new_tokens, ratio, n_markers, kept_ok, retrievable_ok, faithful): whether what must stay is visible
    and every marker's original is stored, byte for byte by its hash."""
    c = c or C.Config(min_bytes=0, query=None)
    blocks = fixtures.select(F.col("name").alias("block_id"), F.col("content").alias("text"), F.lit(None).cast("string").alias("query"), "must_keep")
    done = C.compress_blocks(blocks, c)
    marks = C.find_markers(F.col("new_text"))
    stored = F.transform("dropped", lambda d: F.when(F.substring(F.sha2(d["original"], 256), 1, 16) == d["hash"], d["hash"]))
    out = done.select(
        F.col("block_id").alias("name"), "orig_tokens", "new_tokens", F.when(F.col("orig_tokens") > 0, 1 - F.col("new_tokens") / F.col("orig_tokens")).otherwise(0.0).alias("ratio"),
        F.size(F.array_distinct(F.transform(marks, lambda m: m["hash"]))).alias("n_markers"), F.forall("must_keep", lambda k: F.contains("new_text", k)).alias("kept_ok"),
        (F.size(F.array_except(F.transform(marks, lambda m: m["hash"]), stored)) == 0).alias("retrievable_ok"),
    )
    return out.withColumn("faithful", F.col("kept_ok") & F.col("retrievable_ok"))
