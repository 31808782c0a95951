"""Conversations: dialects and their conversion, prefix caches, cache breakpoints, reply length, output reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predict, volatile
from ..functions.text import token_count

STABLE = ("system", "developer")
#: Least tokens of a prefix that providers cache, and the characters and number of cache breakpoints: fixed values.
LEAST_PREFIX = {"openai": 1024, "google": 1024, "anthropic": 1024}
BREAK_CHARS, BREAKS = 2048, 4


def dialect(messages: DataFrame) -> DataFrame:
    """(conv_id, dialect): openai or anthropic by the first decisive message of (conv_id, msg_index, role, blocks or types
    array<string>); openai without one, unknown for a conversation of nulls."""
    types = F.col("types") if "types" in messages.columns else F.transform("blocks", lambda b: b["type"]) if "blocks" in messages.columns else F.lit(None).cast("array<string>")
    has = lambda *names: F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, names))), F.lit(False))
    calls = F.col("tool_call_id").isNotNull() if "tool_call_id" in messages.columns else F.lit(False)
    signal = (
        F.when(F.col("role").isin("tool", "system", "function") | calls, "openai")
        .when(has("tool_use", "tool_result"), "anthropic")
        .when(has("image_url", "input_audio"), "openai")
    )
    found = messages.groupBy("conv_id").agg(F.min(F.when(signal.isNotNull(), F.struct("msg_index", signal.alias("s")))).alias("m"), F.count("role").alias("n"))
    return found.select("conv_id", F.coalesce("m.s", F.when(F.col("n") == 0, "unknown").otherwise("openai")).alias("dialect"))


def to_anthropic(messages: DataFrame) -> DataFrame:
    """(conv_id, msg_index, role, content, blocks): system messages left out, tool messages as user messages with a
    tool_result block."""
    tool = F.col("role") == "tool"
    call = F.col("tool_call_id") if "tool_call_id" in messages.columns else F.lit(None).cast("string")
    block = F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), F.col("content").alias("content")))
    return messages.filter("role != 'system'").select(
        "conv_id", "msg_index", F.when(tool, "user").otherwise(F.col("role")).alias("role"), F.when(~tool, F.col("content")).alias("content"), F.when(tool, block).alias("blocks")
    )


def to_openai(messages: DataFrame) -> DataFrame:
    """(conv_id, msg_index, part, role, content, tool_call_id): block lists become one message of their text blocks, joined by
    newlines, and a tool message for each tool_result; others stay."""
    texts = F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"])
    results = F.filter("blocks", lambda b: b["type"] == "tool_result")
    one = lambda role, content, call: F.struct(role.alias("role"), content.alias("content"), call.alias("tool_call_id"))
    nothing = F.lit(None).cast("string")
    first = F.when(F.size(texts) > 0, F.array(one(F.col("role"), F.array_join(texts, "\n"), nothing))).otherwise(F.expr("cast(array() as array<struct<role: string, content: string, tool_call_id: string>>)"))
    made = F.concat(first, F.transform(results, lambda b: one(F.lit("tool"), b["content"], b["tool_use_id"])))
    plain = F.array(one(F.col("role"), F.col("content"), nothing))
    out = messages.select("conv_id", "msg_index", F.posexplode(F.when(F.col("blocks").isNull(), plain).otherwise(made)).alias("part", "m"))
    return out.select("conv_id", "msg_index", "part", "m.*")


def stable_order(messages: DataFrame) -> DataFrame:
    """messages with place: system and developer messages first, each group in its order."""
    order = Window.partitionBy("conv_id").orderBy((~F.coalesce(F.col("role").isin(*STABLE), F.lit(False))).cast("int"), "msg_index")
    return messages.withColumn("place", F.row_number().over(order) - 1)


def prefix_report(messages: DataFrame, provider: str = "openai") -> DataFrame:
    """(conv_id, prefix_tokens, cacheable, hoisted, n_stable, uuid, token, timestamp, hash, hints): what of each conversation
    a prompt cache can keep, after volatile content of system messages is replaced."""
    if provider not in LEAST_PREFIX:
        raise ValueError(f"unknown provider {provider!r}; expected one of {sorted(LEAST_PREFIX)}")
    m = stable_order(messages).withColumn("_s", F.coalesce(F.col("role").isin(*STABLE), F.lit(False)))
    text = F.coalesce("content", F.lit(""))
    spans = volatile.counts(text)
    agg = [F.sum(F.when(F.col("_s"), n).otherwise(0)).alias(k) for k, n in spans.items()]
    hoisted = F.max((F.col("_s") & (F.col("place") != F.col("_at"))).cast("int")) == 1
    prefix = F.array_sort(F.collect_list(F.when(F.col("_s"), F.struct("place", volatile.normalize(text).alias("t")))))
    m = m.withColumn("_at", F.row_number().over(Window.partitionBy("conv_id").orderBy("msg_index")) - 1)
    out = m.groupBy("conv_id").agg(F.array_join(F.transform(prefix, lambda x: x["t"]), "\n").alias("_p"), F.count_if("_s").alias("n_stable"), hoisted.alias("hoisted"), *agg)
    tokens = token_count(F.col("_p"))
    least = LEAST_PREFIX[provider]
    out = out.withColumn("prefix_tokens", tokens).withColumn("cacheable", F.col("prefix_tokens") >= least)
    hint = [F.when(F.col("hoisted"), "a system message stood after other turns and was put first")]
    hint += [F.when(F.col(k) > 0, F.concat(F.lit("system messages hold "), F.col(k).cast("string"), F.lit(f" changing {k} value(s): say them in a later message"))) for k in sorted(spans)]
    hint += [F.when(F.col("n_stable") == 0, "there is no system message: fixed instructions and tools belong in one")]
    hint += [F.when(~F.col("cacheable"), F.concat(F.lit("the fixed prefix has "), F.col("prefix_tokens").cast("string"), F.lit(f" tokens and {provider} caches from {least} on: put more of what stays the same in front")))]
    return out.withColumn("hints", F.array_compact(F.array(*hint))).drop("_p")


def cache_breakpoints(messages: DataFrame, chars: int = BREAK_CHARS, most: int = BREAKS) -> DataFrame:
    """messages with breakpoint: the last `most` messages of each conversation with `chars` characters or more."""
    able = F.length(F.coalesce("content", F.lit(""))) >= chars
    rank = F.row_number().over(Window.partitionBy("conv_id", able).orderBy(F.desc("msg_index")))
    return messages.withColumn("breakpoint", able & (rank <= most))


def stable_prefix(messages: DataFrame) -> DataFrame:
    """messages (conv_id, place, msg_index, role, content) as they should be sent: those of stable_order() in their places, with
    placeholders for what changes in system and developer messages, so that equal instructions make equal prefixes."""
    stable = F.coalesce(F.col("role").isin(*STABLE), F.lit(False))
    return stable_order(messages).select("conv_id", "place", "msg_index", "role", F.when(stable, volatile.normalize(F.col("content"))).otherwise(F.col("content")).alias("content"))


def _control(on: Column | bool) -> Column:
    return F.when(F.lit(on) if isinstance(on, bool) else on, F.struct(F.lit("ephemeral").alias("type"))).alias("cache_control")


def with_cache_control(messages: DataFrame, systems: DataFrame | None = None, chars: int = BREAK_CHARS, most: int = BREAKS) -> tuple[DataFrame, DataFrame | None]:
    """(messages, systems) with cache_control in at most `most` places of a conversation.

    messages: conv_id, msg_index, role, content and, where a message is a list, blocks (array of structs with type and text).
    systems: conv_id and system, one row for each conversation that has a separate system prompt. A system prompt of `chars`
    characters or more is marked first and takes one place; then the last messages whose text, or whose last block if that
    is a text, has `chars` characters or more. A marked text becomes a list of one block and its content null; of a list the
    last block is marked. What isn't marked stays. A null conv_id is a conversation of its own.
    """
    if "blocks" not in messages.columns:
        messages = messages.withColumn("blocks", F.lit(None).cast("array<struct<type: string, text: string>>"))
    kept = [c for c in messages.columns if c not in ("content", "blocks")]
    last = F.try_element_at("blocks", F.lit(-1))
    text = F.coalesce("content", F.when(last["type"] == "text", last["text"]), F.lit(""))
    m = messages.withColumn("_able", F.length(text) >= chars).withColumn("_spent", F.lit(0))
    if systems is not None:
        large = F.length(F.coalesce("system", F.lit(""))) >= (chars if most > 0 else 2**31 - 1)
        spent = systems.filter(large).select(F.col("conv_id").alias("_conv")).distinct()
        m = m.drop("_spent").join(spent.withColumn("_one", F.lit(1)), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").withColumn("_spent", F.coalesce("_one", F.lit(0)))
        block = F.struct(F.lit("text").alias("type"), F.col("system").alias("text"), _control(True))
        systems = systems.select("conv_id", F.when(~large, F.col("system")).alias("system"), F.when(large, F.array(block)).alias("blocks"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "_able").orderBy(F.desc("msg_index")))
    m = m.withColumn("_mark", F.col("_able") & (rank <= most - F.col("_spent")))
    plain = F.col("_mark") & F.col("content").isNotNull()
    parts = {"type": F.lit("text"), "text": F.col("content")}
    fields = [f for f in messages.schema["blocks"].dataType.elementType.fields if f.name != "cache_control"]
    made = F.array(F.struct(*[parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], _control(True)))
    end = F.size("blocks") - 1
    listed = F.transform("blocks", lambda b, i: F.struct(*[b[f.name].alias(f.name) for f in fields], _control(F.col("_mark") & (i == end))))
    out = m.select(*kept, F.when(~plain, F.col("content")).alias("content"), F.when(plain, made).otherwise(listed).alias("blocks"))
    return out, systems


def prompt_features(messages: DataFrame) -> DataFrame:
    """(conv_id, the thirteen features) of each conversation."""
    text = F.coalesce("content", F.lit(""))
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("msg_index", text.alias("t"))))), lambda x: x["t"]), "\n")
    g = messages.groupBy("conv_id").agg(
        joined(text != "").alias("full"), joined(F.col("role") == "system").alias("system"), F.count("*").alias("n"),
        F.coalesce(F.max(F.when(F.col("role") == "user", F.struct("msg_index", text.alias("t"))))["t"], F.lit("")).alias("last"),
    )
    f = predict.features(F.col("full"), F.col("last"), F.col("system"), F.col("n"))
    return g.select("conv_id", *[c.alias(k) for k, c in f.items()])


def predicted(messages: DataFrame, safety: float = 1.5) -> DataFrame:
    """(conv_id, tokens, low, high, confidence, max_tokens)."""
    f = prompt_features(messages)
    out = f.select("conv_id", predict.prediction({k: F.col(k) for k in predict.WEIGHTS}).alias("p")).select("conv_id", "p.*")
    return out.withColumn("max_tokens", predict.max_tokens(F.col("tokens"), F.col("high"), safety))


#: What asks a model for shorter replies, by level.
LEVELS = {
    "off": "",
    "balanced": "Keep replies short: give the answer first, leave out what the reader already has, and do not repeat the request.",
    "aggressive": "Keep replies short: give the answer first, leave out what the reader already has, and do not repeat the request. Show changed lines only, no boilerplate, no closing remarks.",
}
SAFETY = {"off": 1.5, "balanced": 1.5, "aggressive": 1.2}


def reduce_output(messages: DataFrame, level: str = "balanced") -> DataFrame:
    """messages (conv_id, msg_index, role, content) with the level's instruction at the end of each conversation's first system
    message, or in a system message of its own before all others (msg_index -1). An unknown level is off."""
    text = LEVELS.get(level, "")
    m = messages.select("conv_id", "msg_index", "role", "content")
    if not text:
        return m
    first = F.min(F.when(F.col("role") == "system", F.col("msg_index"))).over(Window.partitionBy("conv_id"))
    m = m.withColumn("_first", first)
    said = F.when(F.coalesce("content", F.lit("")) == "", text).otherwise(F.concat("content", F.lit("\n\n" + text)))
    kept = m.select("conv_id", "msg_index", "role", F.when(F.col("_first") == F.col("msg_index"), said).otherwise(F.col("content")).alias("content"))
    own = m.filter("_first is null").select("conv_id").distinct()
    return kept.unionByName(own.select("conv_id", F.lit(-1).cast(m.schema["msg_index"].dataType).alias("msg_index"), F.lit("system").alias("role"), F.lit(text).alias("content")))


def output_delta(baseline: Column, reduced: Column) -> Column:
    """struct<baseline_tokens, reduced_tokens, saved_tokens, ratio> of two replies."""
    b, r = token_count(baseline), token_count(reduced)
    return F.struct(b.alias("baseline_tokens"), r.alias("reduced_tokens"), (b - r).alias("saved_tokens"), F.when(b > 0, 1 - r / b).otherwise(0.0).alias("ratio"))
