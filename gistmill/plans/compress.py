"""The compression pipeline: messages to blocks, blocks to their compressors, guarded rewrites, a table of dropped originals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.detect import detected
from ..functions.markers import find_markers
from ..functions.text import strip, token_count
from ..operators import diff, logs, markup, prose, search, tabular

Compressor = Callable[[DataFrame, "Config"], DataFrame]

#: Setting that bounds the bytes of texts in a batch that goes to Python, Spark's default, and what stands in its place
#: (never in that of a value that the user chose).
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


@dataclass(frozen=True)
class Config:
    """The knobs that change results."""

    enabled: bool = True
    min_bytes: int = 200
    min_token_savings: int = 0
    compressors: tuple[str, ...] | None = None  # names allowed to run; None: all
    query: str | None = "auto"
    keep_head: int = 5
    keep_tail: int = 3
    min_items: int = 12
    max_items: int | None = None
    max_rare: int = 5
    max_json_depth: int = 200
    log_context: int = 1
    search_max_files: int = 20
    target_ratio: float = 0.2
    diff_max_files: int = 10
    diff_max_hunks: int = 4
    diff_context: int = 2
    code_max_bytes: int = 262_144
    html_keep_links: bool = False
    csv_keep_head: int = 5
    csv_keep_tail: int = 3
    csv_max_outliers: int = 5
    registry: dict[str, tuple[str, Compressor]] = field(default_factory=dict)  # content type: (name, compressor), over the defaults

    def merged(self, **overrides) -> Config:
        """With overrides; None leaves a value as it is, so a query is taken away only by Config(query=None)."""
        return replace(self, **{k: v for k, v in overrides.items() if v is not None})


def _queries(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_id", F.coalesce("query", F.lit("")).alias("query"))


def _code(blocks: DataFrame, c: Config) -> DataFrame:
    """What is no Python or JavaScript, or too long, is treated as prose."""
    done = markup.apply(blocks, lambda t: markup.code(t, c.code_max_bytes) or (None, []))
    rest = blocks.join(done.filter("new_text is null").select("block_id"), "block_id", "left_semi")
    return done.filter("new_text is not null").select("block_id", "new_text", "dropped").unionByName(prose.compress(rest, c.target_ratio, F.col("query")))


#: Content type: (name, compressor). Each compressor maps (block_id, text, query) to (block_id, new_text, dropped).
DEFAULTS: dict[str, tuple[str, Compressor]] = {
    "json": ("smartcrusher", lambda b, c: markup.apply(b.withColumn("query", F.coalesce("query", F.lit(""))), lambda t, q: markup.crushed(t, q, c.keep_head, c.keep_tail, c.min_items, c.max_items, c.max_rare, c.max_json_depth), "query")),
    "log": ("log-compressor", lambda b, c: logs.compress(b, c.log_context)),
    "search": ("search-compressor", lambda b, c: search.compress(b, c.search_max_files, _queries(b))),
    "diff": ("diff-compressor", lambda b, c: diff.compress(b, c.diff_max_files, c.diff_max_hunks, c.diff_context, c.target_ratio)),
    "code": ("code-compressor", _code),
    "html": ("html-extractor", lambda b, c: markup.apply(b, lambda t: markup.html_text(t, c.html_keep_links))),
    "csv": ("tabular", lambda b, c: tabular.compress(b, c.csv_keep_head, c.csv_keep_tail, c.csv_max_outliers)),
    "markdown": ("text-compressor", lambda b, c: prose.compress(b, c.target_ratio, F.col("query"))),
    "text": ("text-compressor", lambda b, c: prose.compress(b, c.target_ratio, F.col("query"))),
}


def resolve_query(messages: DataFrame, c: Config) -> DataFrame:
    """messages (conv_id, msg_index, role, content) with query: under "auto" the first 512 characters of the last user message
    with a text, which is itself compressed without a query; else the given text, or null."""
    if c.query != "auto":
        return messages.withColumn("query", F.lit(c.query).cast("string"))
    asked = F.when((F.col("role") == "user") & (strip(F.coalesce("content", F.lit(""))) != ""), F.struct("msg_index", F.substring(strip(F.col("content")), 1, 512).alias("q")))
    last = F.max(asked).over(Window.partitionBy("conv_id"))
    return messages.withColumn("_last", last).withColumn("query", F.when(F.col("_last.msg_index") != F.col("msg_index"), F.col("_last.q"))).drop("_last")


def route(blocks: DataFrame, c: Config | None = None) -> DataFrame:
    """blocks (block_id, text, query) with content_type, confidence, compressor and run.

    The type is detected first; then blocks under min_bytes get 'skip', types without a compressor 'none'; run says whether
    the compressor is allowed.
    """
    c = c or Config()
    table = DEFAULTS | c.registry
    out = detected(blocks).withColumns({"content_type": F.col("detected.content_type"), "confidence": F.col("detected.confidence")}).drop("detected")
    names = F.create_map(*[F.lit(x) for kind, (name, _) in table.items() for x in (kind, name)])
    name = F.when(F.octet_length("text") < c.min_bytes, "skip").otherwise(F.coalesce(F.try_element_at(names, F.col("content_type")), F.lit("none")))
    allowed = F.lit(True) if c.compressors is None else F.col("compressor").isin(*c.compressors)
    return out.withColumn("compressor", name).withColumn("run", ~F.col("compressor").isin("skip", "none") & allowed)


def compress_blocks(blocks: DataFrame, c: Config | None = None) -> DataFrame:
    """blocks (block_id, text, query, others) with content_type, confidence, compressor, changed, skipped, orig_tokens,
    new_tokens, new_text, dropped and error.

    Each type's rows go through their compressor, a filter of the routed blocks. A rewrite is kept only if it saves over
    min_token_savings tokens, else the block is as it was and skipped. The routed blocks are kept (in memory, and on disk
    beyond it) while they are read for each type, and only types that occur get a branch of the plan: a count of at most
    nine types goes to the driver. block_id need not be unique, nor there: compressors get a key of id, query and text, and
    rows that are equal in all three are compressed once and each get the result.
    """
    c = c or Config()
    key, default, value = BATCH
    if blocks.sparkSession.conf.get(key, default) == default:
        blocks.sparkSession.conf.set(key, value)
    parts = [x for f in ("block_id", "query", "text") for x in (F.col(f).isNull(), F.col(f))]
    routed = route(blocks, c).withColumn("_key", F.concat(F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *parts))))
    none = F.expr("cast(array() as array<struct<hash: string, original: string>>)")
    if not c.enabled:
        routed = routed.withColumn("run", F.lit(False))
    routed = routed.persist(StorageLevel.MEMORY_AND_DISK)
    present = {r["content_type"] for r in routed.filter("run").select("content_type").distinct().collect()}
    single = not routed.filter("run").groupBy("_key").count().filter("count > 1").limit(1).count()
    done = None
    for kind, (_, run) in (DEFAULTS | c.registry).items():
        if kind not in present:
            continue
        rows = routed.filter((F.col("content_type") == kind) & F.col("run")).select(F.col("_key").alias("block_id"), "text", "query")
        own = run(rows if single else rows.dropDuplicates(["block_id"]), c)
        own = own.select(F.col("block_id").alias("_key"), "new_text", "dropped", (F.col("error") if "error" in own.columns else F.lit(None).cast("string")).alias("error"))
        done = own if done is None else done.unionByName(own)
    out = routed.join(done, "_key", "left") if done is not None else routed.withColumns({"new_text": F.lit(None).cast("string"), "dropped": none, "error": F.lit(None).cast("string")})
    text, made = F.coalesce("text", F.lit("")), F.coalesce("new_text", "text", F.lit(""))
    out = out.withColumns({"orig_tokens": token_count(text), "_cand": token_count(made), "_made": made})
    win = (F.col("_made") != text) & (F.col("orig_tokens") - F.col("_cand") > c.min_token_savings)
    return out.withColumn("changed", win).withColumns({
        "skipped": ~F.col("run") | ((F.col("_made") != text) & ~win),
        "new_tokens": F.when(win, F.col("_cand")).otherwise(F.col("orig_tokens")),
        "new_text": F.when(win, F.col("_made")).otherwise(F.col("text")),
        "dropped": F.when(win, F.coalesce("dropped", none)).otherwise(none),
    }).drop("_cand", "_made", "run", "_key")


def message_blocks(messages: DataFrame, c: Config | None = None) -> DataFrame:
    """(block_id, conv_id, msg_index, path, text, query): a block for each text of messages (conv_id, msg_index, role, content,
    and, where there is one, blocks array<struct<type, text, content>> of text and tool_result blocks). block_id names the
    message by all that it holds, and the text's path in it."""
    m = resolve_query(messages, c or Config()).withColumn("_m", message_key(messages))
    plain = m.filter("content is not null").select("_m", "conv_id", "msg_index", F.lit("content").alias("path"), F.col("content").alias("text"), "query")
    if "blocks" in messages.columns:
        b = m.filter("content is null").select("_m", "conv_id", "msg_index", "query", F.posexplode("blocks").alias("i", "b"))
        at = F.concat(F.lit("content["), F.col("i").cast("string"), F.lit("]."))
        b = b.filter((F.col("b.type") == "text") | (F.col("b.type") == "tool_result"))
        is_text = F.col("b.type") == "text"
        b = b.select("_m", "conv_id", "msg_index", F.concat(at, F.when(is_text, "text").otherwise("tool_result")).alias("path"), F.when(is_text, F.col("b.text")).otherwise(F.col("b.content")).alias("text"), "query")
        plain = plain.unionByName(b.filter("text is not null"))
    return plain.withColumn("block_id", F.concat("_m", F.lit("/"), "path")).drop("_m")


def message_key(messages: DataFrame) -> Column:
    """128 bits, as text, of a message's conversation, place, role and contents; nulls differ from all values."""
    parts = [x for f in ("conv_id", "msg_index", "role", "content", "blocks") if f in messages.columns for x in (F.col(f).isNull(), F.col(f))]
    return F.concat(F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *parts)))


def compress_messages(messages: DataFrame, c: Config | None = None) -> DataFrame:
    """compress_blocks() of message_blocks()."""
    return compress_blocks(message_blocks(messages, c), c)


def rebuilt(messages: DataFrame, compressed: DataFrame) -> DataFrame:
    """messages with the texts of compress_messages() in the place of theirs: in content, and in the text or content of their
    blocks. Everything else stays, as do messages without a text; repeated messages stay repeated."""
    at = F.split("block_id", "/", 2)
    texts = compressed.filter("changed").select(F.get(at, F.lit(0)).alias("_m"), F.get(at, F.lit(1)).alias("p"), "new_text").dropDuplicates(["_m", "p"])
    found = texts.groupBy("_m").agg(F.map_from_entries(F.collect_list(F.struct("p", "new_text"))).alias("_new"))
    out = messages.withColumn("_m", message_key(messages)).join(found, "_m", "left")
    made = {"content": F.coalesce(F.col("_new")["content"], F.col("content"))}
    if "blocks" in messages.columns:
        new = lambda i, kind: F.col("_new")[F.concat(F.lit("content["), i.cast("string"), F.lit(f"].{kind}"))]
        put = lambda b, i: b.withField("text", F.coalesce(new(i, "text"), b["text"])).withField("content", F.coalesce(new(i, "tool_result"), b["content"]))
        made["blocks"] = F.when(F.col("_new").isNull(), F.col("blocks")).otherwise(F.transform("blocks", put))
    return out.withColumns(made).select(*messages.columns)


def compress_documents(docs: DataFrame, c: Config | None = None, query: str | None = None) -> DataFrame:
    """Each document (doc_id, text) a conversation of its own, with one query for all or none."""
    blocks = docs.select(F.col("doc_id").cast("string").alias("block_id"), F.col("doc_id").alias("conv_id"), F.lit(0).alias("msg_index"), F.lit("content").alias("path"), "text", F.lit(query).cast("string").alias("query"))
    return compress_blocks(blocks.filter("text is not null"), c)


def totals(compressed: DataFrame, *by: str) -> DataFrame:
    """(by, orig_tokens, new_tokens, saved_tokens, ratio)."""
    out = compressed.groupBy(*by).agg(F.sum("orig_tokens").alias("orig_tokens"), F.sum("new_tokens").alias("new_tokens"))
    o, n = F.col("orig_tokens"), F.col("new_tokens")
    return out.withColumns({"saved_tokens": o - n, "ratio": F.when(o > 0, 1 - n / o).otherwise(0.0)})


def dropped_originals(compressed: DataFrame) -> DataFrame:
    """(hash, original) of what compress_blocks() dropped, one row for each hash."""
    return compressed.select(F.explode("dropped").alias("d")).select("d.hash", "d.original").dropDuplicates(["hash"])


def markers_of(texts: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep, hash, count, reason) of all markers in texts."""
    return texts.select(*keep, F.explode(find_markers(F.col(text))).alias("m")).select(*keep, "m.*")
