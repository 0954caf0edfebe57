"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events of conversations: conv_id, seq, event, message, role, text.
  message      starts a message with a role and a first text
  delta        appends text to its message
  edit         replaces what its message said so far
  regenerate   empties its message and abandons all messages that began between it and this event
The log is partitioned by conversation and sorted by sequence, folded into final messages, then
rendered. A rendered turn is START role newline text END newline. Inside roles and texts, whatever
looks like the beginning of a control string gets one more backslash, which parse() takes out again.

A conversation is one value in the end, so its messages meet in one task; conversations of any
number spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = ("assistant",)  # roles under the loss mask


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    """A role stands on one line: backslash and newline are written as two characters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    # Pairs are read from the left: a doubled backslash first, then a written newline.
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def folded(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, seq (of the message event), role, text.

    Null text counts as empty, a null role as "". Events of equal seq are taken in the order message,
    edit, regenerate, delta, then by text. A null conv_id is a conversation of its own, a null seq
    comes first. Deltas of a message without a message event make one with an empty role. Columns
    beside the six are unread.
    """
    rank = F.expr("CASE event WHEN 'message' THEN 0 WHEN 'edit' THEN 1 WHEN 'regenerate' THEN 2 ELSE 3 END")
    events = events.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    reset = F.col("e.rank") < 3
    messages = (
        events.repartition("conv_id")
        .groupBy("conv_id", "message")
        .agg(
            F.sort_array(F.collect_list("e")).alias("es"),
            F.min("e").alias("first"),
            F.max(F.when(reset, F.col("e"))).alias("reset"),
            F.max(F.when(F.col("e.rank") == 2, F.col("e.seq"))).alias("again"),
            F.min_by("role", F.col("e")).alias("role"),
        )
        .select(
            "conv_id",
            F.col("first.seq").alias("seq"),
            "message",
            "role",
            "again",
            F.array_join(
                F.transform(F.filter("es", lambda e: F.col("reset").isNull() | (e >= F.col("reset"))), lambda e: F.when(e["rank"] == 2, F.lit("")).otherwise(e["text"])),
                "",
            ).alias("text"),
        )
    )
    earlier = Window.partitionBy("conv_id").orderBy("seq", "message").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("gone_until", F.max("again").over(earlier)).filter("gone_until IS NULL OR seq > gone_until").select("conv_id", "seq", "message", "role", "text")


def rendered(messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """conv_id, formatted, loss_spans: the learned texts' ranges (start from 0, length) in code points of formatted."""
    role, text = _role_out(F.col("role")), escaped(F.col("text"))
    turns = messages.select("conv_id", "seq", "message", F.col("role").isin(*learned).alias("learn"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    earlier = Window.partitionBy("conv_id").orderBy("seq", "message").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn")).over(earlier), F.lit(0)) + F.char_length("head")
    turns = turns.withColumn("span", F.struct(start.cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "message", "turn", "learn", "span"))).alias("ts"))
    return whole.select("conv_id", F.array_join(F.col("ts.turn"), "").alias("formatted"), F.filter("ts", lambda t: t["learn"])["span"].alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            _role_in(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(t, F.instr(t, "\n") + 1)).alias("text"),
        ),
    )


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped: each span in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of the formatted text gets: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def as_events(turns: DataFrame) -> DataFrame:
    """Rows of whole turns (conv_id, turn, role, text) as a log: one message event for each row.

    Repeated turns of a conversation stay separate messages, by role and then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order)
    return turns.select("conv_id", n.alias("seq"), F.lit("message").alias("event"), n.alias("message"), "role", "text")


PIECES = 3  # deltas in which a streamed text arrives


def as_log(turns: DataFrame) -> DataFrame:
    """Rows of whole turns as the log that a chat service would have kept of them; folded() gives the turns back.

    Texts of learned roles are streamed: an empty message, a first answer in deltas, a regeneration that gives it
    up, and the final text in PIECES deltas. Others are sent in part, then edited to their final text.
    """
    whole = as_events(turns)
    said = F.coalesce("text", F.lit(""))
    n = F.char_length(said)
    at = lambda i: F.floor(n * i / PIECES).cast("int")
    event = lambda kind, text: F.struct(F.lit(kind).alias("event"), text.alias("text"))
    pieces = [event("delta", F.substr(said, at(i) + 1, at(i + 1) - at(i))) for i in range(PIECES)]
    streamed = F.array(event("message", F.lit("")), event("delta", F.reverse(said)), event("delta", F.lit("...")), event("regenerate", F.lit(None).cast("string")), *pieces)
    edited = F.array(event("message", F.substr(said, F.lit(1), at(1))), event("delta", F.lit("...")), event("edit", said))
    events = whole.select("conv_id", "message", "role", F.posexplode(F.when(F.col("role").isin(*LEARNED), streamed).otherwise(edited)).alias("i", "e"))
    return events.select("conv_id", (F.col("message") * (len(pieces) + 4) + F.col("i")).alias("seq"), "e.event", "message", "role", "e.text")


def format_conversations(events: DataFrame) -> DataFrame:
    return rendered(folded(events))
