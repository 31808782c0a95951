"""Chat examples by prefix-target expansion, with a reversible template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings: fixed values.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What texts may not show unescaped: the start of the template's own control strings and of common ones.
_CONTROL = r"<(?=\|)|<(?=/?s>)|\[(?=/?INST\])"


def escaped(text) -> F.Column:
    """Doubles backslashes and puts one inside every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_CONTROL})", "$1\\\\")


def unescaped(text) -> F.Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _turn(t) -> F.Column:
    return F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(END))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no, formatted, loss_start, loss_end): one example for each assistant turn.

    An example is the conversation up to its assistant turn, which alone is trainable: the code points from loss_start
    to loss_end (exclusive) of `formatted` are that turn's escaped text. Turns after the last assistant turn, or a
    conversation without one, give a last example with an empty loss range, so that no turn is lost. Every turn is
    written as <|turn|>role<|text|>text<|end|>; in roles and texts a backslash goes before every backslash and into
    every control string, which read_turns() takes back.

    Rows are (conv_id, turn, role, text); a conversation is ordered by turn, ties by role and then text, nulls first.
    Null role or text: empty. Null conv_id: a conversation of its own. Repeated rows are turns of their own. An empty
    table gives no rows; other columns are ignored. An example holds its whole prefix, so the output of a conversation
    grows with the square of its turns, as the format asks; each example is built in a row of its own from the
    conversation's turns, which one row holds.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    last = F.transform(F.col("turns"), lambda t, i: F.when((t["role"] == "assistant") | (i == F.size("turns") - 1), i))
    n = F.col("turn_no")
    target = F.element_at("turns", n + 1)
    reply = target["role"] == "assistant"
    formatted = F.array_join(F.transform(F.slice("turns", F.lit(1), n + 1), _turn), "")
    end = F.length("formatted") - F.when(F.col("reply"), len(END)).otherwise(0)
    return (
        conversations.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select("conv_id", "turns", F.explode(F.filter(last, lambda i: i.isNotNull())).alias("turn_no"))
        .select("conv_id", "turn_no", formatted.alias("formatted"), reply.alias("reply"), F.when(reply, F.length(escaped(target["text"]))).otherwise(0).alias("n"))
        .select("conv_id", "turn_no", "formatted", (end - F.col("n")).alias("loss_start"), end.alias("loss_end"))
    )


def read_turns(formatted) -> F.Column:
    """The array of {role, text} that a formatted string holds."""
    split_at = lambda c, mark: F.split(c, mark.replace("|", r"\|"))
    bodies = F.slice(split_at(formatted, TURN), 2, F.size(split_at(formatted, TURN)))

    def read(body):
        return F.struct(
            unescaped(F.substring_index(body, TEXT, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(body, TEXT, -1), END, 1)).alias("text"),
        )

    return F.transform(bodies, read)


def read_loss() -> F.Column:
    """The trainable text of an example's row."""
    return unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from examples()."""
    parts = F.array_sort(F.collect_list(F.struct("turn_no", read_loss().alias("loss"))))
    gathered = formatted.groupBy("conv_id").agg(
        F.max_by("formatted", "turn_no").alias("longest"), parts.alias("parts"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars")
    )
    turns = F.transform(read_turns(F.col("longest")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = gathered.select("conv_id", turns.alias("turns"), F.array_join("parts.loss", "").alias("loss"), "formatted_chars")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""with c as (select conv_id, turn, role, text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c),
e as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
  8 + 8 + 7 + length(regexp_replace(replace(role, '\', '\\'), '<(/?s>|\|)|\[(/?INST\])', '<\\\1\2', 'g'))
  + length(regexp_replace(replace(text, '\', '\\'), '<(/?s>|\|)|\[(/?INST\])', '<\\\1\2', 'g')) as chars
  from t window w as (partition by conv_id order by turn nulls first, role, text)),
s as (select *, sum(chars) over (partition by conv_id order by i) as upto from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (where role = 'assistant' or i = n)::bigint as formatted_chars
from s group by conv_id"""
