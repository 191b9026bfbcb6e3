"""Chat formatting by event-sourced reconstruction.

A log has conv_id, message, seq, op, role, text. Per message in the order of seq: `delta` appends its text, `edit`
replaces what there is, `regenerate` starts anew with its text. A message's role is that of its first event. Final
messages are rendered in order as `<|turn|>role\\ntext<|end|>\\n`; inside texts a `<|` gets one more backslash between
its characters, which read_back() takes away again. The loss mask lists start and length, in code points, of every
assistant text.

Events of one seq go by kind (deltas first, so that an edit or a regeneration replaces them), then by text; events with a
null seq come first; of equal replacements one counts, equal deltas all do.
Null texts are empty, null roles too; a null conversation id is one conversation; rows of a table with equal turns are
ordered by role and text, repeated ones stay separate turns; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TURN, END = "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def table_events(rows: DataFrame) -> DataFrame:
    """The log of a finished table (conv_id, turn, role, text).

    Every text arrives in two deltas; of each eight messages, by a hash of the place, about one has a false start that is
    generated anew, and one comes in the wrong order and is edited.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", F.row_number().over(order).alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    start, rest = F.left("text", half), F.substring("text", half + 1, F.length("text"))
    events = lambda *parts: F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(op).alias("op"), text.alias("text")) for k, (op, text) in enumerate(parts)])
    how = F.pmod(F.xxhash64("conv_id", "message"), F.lit(8))
    log = (
        F.when(how == 0, events(("delta", rest), ("regenerate", start), ("delta", rest)))
        .when(how == 1, events(("delta", rest), ("delta", start), ("edit", F.col("text"))))
        .otherwise(events(("delta", start), ("delta", rest)))
    )
    return numbered.select("conv_id", "message", "role", F.explode(log).alias("e")).select("conv_id", "message", "e.seq", "e.op", "role", "e.text")


def fold_events(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text of the final messages."""
    replaces = F.col("op").isin("edit", "regenerate")
    event = F.struct(F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"), replaces.cast("int").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    groups = log.select("conv_id", "message", "role", event.alias("event"), replaces.alias("replaces")).groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list("event")).alias("events"), F.max(F.when(F.col("replaces"), F.col("event"))).alias("last"), F.min_by("role", F.struct("event", "role")).alias("role")
    )
    live = F.filter("events", lambda e: F.col("last").isNull() | (e > F.col("last")))
    text = F.concat(F.coalesce("last.text", F.lit("")), F.array_join(F.transform(live, lambda e: e["text"]), ""))
    return groups.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, *, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask (array of start, length) from the final messages."""
    head, body = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    pieces = messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body")).withColumn("piece", F.concat("head", "body", F.lit(END)))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(earlier), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length"))
    groups = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("message", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role") == learn, span))).alias("mask"),
    )
    return groups.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and learnt text that the formatted conversations and their masks hold."""
    parts = F.slice(F.split("formatted", r"<\|turn\|>", -1), F.lit(2), F.size(F.split("formatted", r"<\|turn\|>", -1)))
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))
    turns = F.transform(parts, lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(body(p)).alias("text")))
    learnt = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(learnt, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(read: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(text, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars",
    )


def format_table(rows: DataFrame) -> DataFrame:
    """Formatted conversations of a table, written once to the shared folder."""
    return stored(render(fold_events(table_events(rows))), "chat")
