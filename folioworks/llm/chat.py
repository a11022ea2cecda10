"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations: (conv_id, seq, kind, message, role, text).
Kinds: `message` sets a message's text, `delta` appends a streamed piece,
`edit` replaces the text, `regenerate` empties it for a new attempt, `delete`
removes the message. Events fold per message first, on (conversation, message),
so a long conversation spreads over many tasks; only the rendered messages of a
conversation meet, as one output value must hold them.

The template is `<|im_start|>role NL text<|im_end|>NL` per message. Inside roles and
texts `&` becomes `&amp;` and `<|` becomes `&lt;|` (a role's line breaks become
`&#10;`), so no marker can arise inside and `parse` gets the exact text back.
`loss_mask` lists (start, length) in code points of the text of each assistant
message, in order, without its markers.

Defined results: null roles and texts are empty; unknown kinds, and events of a
null message, are ignored; events with equal seq apply in order of kind, role and text; a
repeated event applies once; a message whose last setting event is a delete is
gone; an empty message is kept; a null conv_id is a conversation of its own; a
conversation without messages gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
KINDS = ("message", "delta", "edit", "regenerate", "delete")
ASSISTANT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(out, F.lit("\n"), F.lit("&#10;")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("&#10;"), F.lit("\n")) if role else text
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, at, role, text): the final messages; `at` is the seq of a message's first event."""
    known = events.where(F.col("kind").isin(*KINDS) & F.col("message").isNotNull())
    # the parts of one message, which its final text is made of
    log = F.array_distinct(F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))))
    grouped = known.groupBy("conv_id", "message").agg(
        F.min("seq").alias("at"), F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role"))).alias("role"), log.alias("log")
    )
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(0))))
    grouped = grouped.withColumn("last", last)
    live = F.slice("log", F.col("last") + 1, F.size("log"))
    text = F.array_join(F.transform(live, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    kept = grouped.where(F.get("log", F.col("last"))["kind"] != "delete")
    return kept.select("conv_id", "message", "at", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_mask) from final messages."""
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    turns = messages.select("conv_id", "at", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("at", "message")
    before = F.sum(F.char_length("turn").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0).cast("long")) + F.char_length("head")
    span = F.when(F.col("role") == ASSISTANT, F.struct(start.alias("start"), F.char_length("body").cast("long").alias("length")))
    placed = turns.select("conv_id", F.row_number().over(order).alias("i"), "turn", span.alias("span"))
    parts = F.sort_array(F.collect_list(F.struct("i", "turn", "span")))
    gathered = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), parts.alias("parts"))
    return gathered.select(
        "conv_id",
        "n_turns",
        F.array_join("parts.turn", "").alias("formatted"),
        F.array_compact(F.col("parts.span")).alias("loss_mask"),
    )


def format_log(events: DataFrame) -> DataFrame:
    """Fold a log and render it."""
    return render(fold(events))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, i, role, text, loss): turns read back from `formatted`; loss is the text under the mask, else null.

    conv_id must be unique.
    """
    pieces = F.split("formatted", r"\Q" + END + r"\E", -1)
    rows = formatted.select("conv_id", F.posexplode(pieces).alias("i", "piece")).where(F.col("piece") != "")
    head = F.substring_index("piece", "\n", 1)
    rows = rows.withColumns({"head": head, "size": F.char_length("piece").cast("long") + len(END)})
    order = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    rows = rows.withColumn("start", offset + F.char_length("head") + 1)
    marks = formatted.select(F.col("conv_id").alias("_c"), F.explode("loss_mask").alias("_m")).select("_c", "_m.*")
    marks = marks.withColumnsRenamed({"start": "_start", "length": "_length"})
    met = rows.join(marks, rows["conv_id"].eqNullSafe(marks["_c"]) & (rows["start"] == marks["_start"]), "left")
    body = F.substr("piece", F.char_length("head") + 2)
    masked = F.substr("piece", F.char_length("head") + 2, F.col("_length").cast("int"))
    role = F.substr("head", F.lit(len(START) + 1))
    return met.select(
        "conv_id",
        "i",
        unescape(role, role=True).alias("role"),
        unescape(body).alias("text"),
        F.when(F.col("_length").isNotNull(), unescape(masked)).alias("loss"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation as read back from its formatted text."""
    turns = F.sort_array(F.collect_list(F.struct("i", "role", "text", "loss")))
    read = parse(formatted).groupBy("conv_id").agg(turns.alias("t"))
    read = read.withColumns(
        {
            "all": F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
            "loss": F.array_join(F.col("t.loss"), ""),
        }
    )
    read = read.select(
        F.col("conv_id").alias("_c"),
        F.size("t").cast("long").alias("n_turns"),
        F.sha2("all", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
    )
    sizes = formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.join(sizes, read["_c"].eqNullSafe(sizes["conv_id"])).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def as_log(conversations: DataFrame) -> DataFrame:
    """A log whose folding gives the turns (conv_id, turn, role, text) back, with drafts that must not survive.

    Assistant turns become an abandoned attempt, a regeneration and two streamed pieces; other turns a draft and an
    edit. Rows with equal turn go by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    half = F.expr("char_length(text) div 2").cast("int")
    first, second, draft = F.substr("text", F.lit(1), half), F.substr("text", half + 1), F.substr("text", F.lit(1), F.lit(24))

    def event(step: int, kind: str, text: Column) -> Column:
        return F.struct((F.col("message") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    none = F.lit("")
    streamed = [
        event(0, "message", none), event(1, "delta", draft), event(2, "regenerate", none), event(3, "delta", first), event(4, "delta", second)
    ]
    typed = [event(0, "message", draft), event(1, "edit", F.col("text"))]
    log = F.when(F.col("role") == ASSISTANT, F.array(*streamed)).otherwise(F.array(*typed))
    return rows.select("conv_id", "message", "role", F.explode(log).alias("_e")).select("conv_id", "_e.seq", "_e.kind", "message", "role", "_e.text")
