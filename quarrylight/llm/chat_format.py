"""Chat formatting from event logs, in DataFrame functions only.

A log is partitioned by conversation and sorted by sequence number; its events are folded into final
messages, which are rendered with turn marks. Kinds of events, each naming a message:

  message     the message's whole text (with its role)
  delta       a streamed piece, appended to what the message holds
  edit        the message's text is replaced
  regenerate  the message is emptied, and all messages that began after it and before this event go

The fold is set-based: a message holds the events since its last message, edit or regenerate event, in
sequence; a conversation holds the messages that no regenerate removed, by their first event.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and texts a backslash
escapes: `\\` is written `\\\\` and `<|` is written `<\\|`, so no mark can appear in a text, and taking
away the backslashes gives the text back. A line end in a role is written as a backslash before it.

One conversation is one output row, so it has to fit a task; its events may lie anywhere. Nulls: a null
text or role is empty, a null kind is `message`, a null sequence number sorts first (also before a regenerate
event), and rows with a null conversation id are one conversation with id null. Equal sequence numbers are
ordered by kind and text; an event that the log repeats (same sequence number, kind and text) counts once.
Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.tables import hex_digest

# Marks of the template. Fixed values.
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turns): final messages as an array of (role, text), from events
    (conv_id, seq, kind, message_id, role, text)."""
    resets = F.col("kind") != "delta"
    tidy = events.select(
        "conv_id", F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), "message_id",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # All events of a conversation go to one task once; both steps below use that distribution.
    dealt = tidy.repartition("conv_id")
    place = F.struct("seq", "kind", "text")
    messages = dealt.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first"),
        F.max(F.when(resets, place)).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.min_by("role", F.struct((F.col("role") == ""), "seq", "role")).alias("role"),
        F.array_sort(F.collect_set(F.struct("seq", "kind", "text"))).alias("parts"),
    )
    since = F.filter(
        "parts", lambda p: F.col("reset").isNull() | (p >= F.col("reset"))
    )
    pieces = F.transform(since, lambda p: F.when(p["kind"] == "regenerate", "").otherwise(p["text"]))
    folded = messages.select(
        "conv_id", "message_id", "first", "regenerated", "role", F.array_join(pieces, "").alias("text")
    )
    whole = folded.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "message_id", "role", "text"))).alias("all"),
        F.collect_list(
            F.when(F.col("regenerated").isNotNull(), F.struct("first", F.col("regenerated").alias("at")))
        ).alias("cuts"),
    )
    stays = F.filter(
        "all", lambda m: ~F.exists("cuts", lambda c: (c["first"] < m["first"]) & (m["first"] < c["at"]))
    )
    return whole.select(
        "conv_id", F.transform(stays, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("turns")
    )


def rendered(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the template's text, and the code point ranges (start, end) of
    what the assistant says, which are the spans to train on."""
    heads = F.transform("turns", lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")))
    bodies = F.transform("turns", lambda t: escaped(t["text"]))
    step = conversations.select("conv_id", "turns", heads.alias("heads"), bodies.alias("bodies"))
    tail = END + "\n"
    shape = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def add(so_far: Column, i: Column) -> Column:
        start = so_far["at"] + F.length(F.get("heads", i))
        end = start + F.length(F.get("bodies", i))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        speaks = F.get("turns", i)["role"] == LOSS_ROLE
        return F.struct(
            (end + len(tail)).alias("at"), F.when(speaks, F.concat(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans")
        ).cast(shape)

    start = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(shape)
    spans = F.when(F.size("turns") > 0, F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), start, add)["spans"])
    text = F.array_join(F.transform(F.arrays_zip("heads", "bodies"), lambda t: F.concat(t["heads"], t["bodies"], F.lit(tail))), "")
    return step.select(
        "conv_id", text.alias("formatted"),
        F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")).alias("loss_spans"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Events to formatted conversations: (conv_id, formatted, loss_spans)."""
    return rendered(fold_events(events))


def parse_chats(chats: DataFrame) -> DataFrame:
    """Formatted text back to (conv_id, formatted, turns, loss_texts): the reverse of the template.

    A start mark begins a turn and an end mark with its line end closes it; neither can stand inside one.
    """
    body = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    head = r"(?s)^((?:[^\\\n]|\\.)*+)\n"

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, head, 1)
        text = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    losses = F.transform(
        "loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    )
    return chats.select("conv_id", "formatted", F.transform(body, turn).alias("turns"), losses.alias("loss_texts"))


def digests(parsed: DataFrame) -> DataFrame:
    """Per conversation what the text read back holds: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        hex_digest(F.array_join(lines, "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), hex_digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
