"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log of events (conv_id, seq, kind, turn, role, text) is partitioned by conversation and sorted by
seq. Kinds: `message` (or null) states a turn's text, `edit` restates it, `regenerate` throws the
turn's text away and starts with its own, `delta` appends to what stands. The final messages are
rendered with a template that marks turns; control strings inside texts are escaped reversibly, and
a loss mask (character spans of the rendered text) covers each assistant text.

Defined results: a null text counts as empty, a null role as the one that the turn had before (empty if none), a null
kind as `message`; null seq sorts first; ties of seq are ordered by kind, role and text; a null conv_id is a conversation of its own;
no events give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: Marks: an assistant turn is <s>role\ntext</s>, any other [INST]role\ntext[/INST].
MARKS = ["<s>", "</s>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    r"""Doubles each backslash, then puts one behind the first character of each mark, so that no mark
    is left in the text; a mark cannot arise where an escaped text meets a real mark either, since
    [ and < only begin marks and ] and > only end them."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for m in MARKS:
        out = F.replace(out, F.lit(m), F.lit(m[0] + "\\" + m[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role ends at the first line feed: one inside it is written as the escape \\n would be read, a
    backslash and a line feed, which the parser does not take for an end."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    log = events.select("conv_id", "turn", F.struct(F.col("seq"), kind.alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    log = log.repartition("conv_id").groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("log"))
    start = F.array_max(F.transform("log", lambda e, i: F.when(e.kind != "delta", i + 1).otherwise(F.lit(1))))
    live = F.slice("log", start, F.size("log"))
    return log.select(
        "conv_id",
        "turn",
        F.coalesce(F.try_element_at(F.filter(F.transform("log", lambda e: e.role), lambda x: x.isNotNull()), F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e.text), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: formatted, and loss_spans (start, length in code points of formatted)."""
    is_loss = F.col("role") == "assistant"
    head = F.concat(F.when(is_loss, F.lit("<s>")).otherwise(F.lit("[INST]")), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    tail = F.when(is_loss, F.lit("</s>")).otherwise(F.lit("[/INST]"))
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.select("conv_id", "turn", is_loss.alias("loss"), head.alias("head"), body.alias("body"), F.concat(head, body, tail).alias("piece"))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(by), F.lit(0)) + F.length("head"))
    one = F.struct("turn", "piece", "loss", F.col("at").alias("start"), F.length("body").cast("long").alias("length"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x.piece), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x.loss), lambda x: F.struct(x.start.alias("start"), x.length.alias("length"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a rendered conversation."""
    parts = F.split(formatted, r"</s>|\[/INST\]", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"^(?:<s>|\[INST\])", ""))
    role = lambda p: F.regexp_extract(p, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
    return F.transform(bare, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substring(p, F.length(role(p)) + 2, F.length(p))).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start + 1, s.length))), "")


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of an event log."""
    return render(fold_events(events))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of conversations is a `message` event; conversation -1 holds control strings."""
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = given.unionByName(own)
    # rows that share a turn stay rows of their own, as the contract counts rows
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    events = rows.select("conv_id", seq.alias("seq"), F.lit("message").alias("kind"), seq.alias("turn"), "role", "text")
    back = format_chats(events).select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for m in MARKS:
        out = f"replace({out}, '{m}', '{m[0]}\\{m[1:]}')"
    return out


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_sql_escape('text')}) + length(replace({_sql_escape('role')}, chr(10), '\\' || chr(10))) + 1
           + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
