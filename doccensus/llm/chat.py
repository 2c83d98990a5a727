"""Conversations rebuilt from event logs and rendered with a reversible template; DataFrame functions only.

An event log has the columns conv_id, turn, seq, event, role, text. Events of one (conversation, turn) are folded in
the order of ``seq``: ``message`` begins a message with its text, ``delta`` adds text, ``edit`` replaces what there
is, ``regenerate`` starts the text anew (with its own text, usually none). A fold that begins with another event
than ``message`` begins a message too. The role is that of the message's first event that has one.

The rendering of a message is ``<|turn|>role<|text|>text<|end|>`` and a line feed. Inside roles and texts every
control string of the common chat templates (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) gets a backslash
after its first character, as does one that already has backslashes there; taking one away restores the text.

``streamed_events`` writes finished messages as the log that a chat service leaves: pieces, drafts, edits.

Defined cases: null text and role are empty; null turn and conversation are keys like others, nulls first; events
with equal ``seq`` are ordered by event, role and text, repeated rows count each; an empty log gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccensus.llm.shared import let

#: code points of a streamed piece
PIECE = 64
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def as_events(messages: DataFrame) -> DataFrame:
    """A table of finished messages as a log: each row is one ``message`` event, ordered by its turn."""
    return messages.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("event"), "role", "text")


def streamed_events(messages: DataFrame, piece: int = PIECE) -> DataFrame:
    """A table of finished messages as a log of streamed ones, which folds to the same messages.

    By a hash of its key a message is streamed in pieces, or streamed as a draft (its text backwards) that is regenerated
    in pieces, or streamed as a draft that an edit replaces. Messages of one turn follow each other by role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    by = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = messages.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("n", F.row_number().over(by))

    def event(name: str, role: Column, text: Column) -> Column:
        return F.struct(F.lit(name).alias("event"), role.cast("string").alias("role"), text.cast("string").alias("text"))

    def pieces(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))

    def deltas(parts: Column) -> Column:
        return F.transform(parts, lambda p: event("delta", F.lit(None), p))

    def streamed(parts: Column) -> Column:
        first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
        return F.concat(F.array(event("message", F.col("role"), first)), deltas(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))))

    draft = let(pieces(F.reverse("text")), streamed)
    again = F.array(event("regenerate", F.lit(None), F.lit(None)))
    kind = F.pmod(F.xxhash64("conv_id", "turn", "n"), F.lit(3))
    events = (
        F.when(kind == 0, let(pieces(F.col("text")), streamed))
        .when(kind == 1, F.concat(draft, again, deltas(pieces(F.col("text")))))
        .otherwise(F.concat(draft, F.array(event("edit", F.lit(None), F.col("text")))))
    )
    told = numbered.select("conv_id", "turn", "n", F.posexplode(events).alias("k", "e"))
    return told.select("conv_id", "turn", (F.col("n").cast("long") * (1 << 32) + F.col("k")).alias("seq"), "e.event", "e.role", "e.text")


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, position (0-based, within the turn), role, text."""
    event = F.struct(
        F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("event").cast("string"), F.lit("delta")).alias("event"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = log.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("events"))
    size = F.size("events")
    starts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.element_at("events", i)["event"] == "message"))

    def message(part: Column) -> Column:
        resets = F.filter(F.sequence(F.lit(1), F.size(part)), lambda i: (i == 1) | F.element_at(part, i)["event"].isin("edit", "regenerate"))
        live = F.slice(part, F.element_at(resets, -1), F.size(part))
        named = F.filter(part, lambda e: e["role"] != "")
        return F.struct(
            F.when(F.size(named) > 0, F.element_at(named, 1)["role"]).otherwise("").alias("role"),
            F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
        )

    def cut(found: Column) -> Column:
        return F.transform(
            found,
            lambda a, k: let(F.slice("events", a, F.when(k + 1 < F.size(found), F.get(found, k + 1)).otherwise(size + 1) - a), message),
        )

    return turns.select("conv_id", "turn", F.posexplode(let(starts, cut)).alias("position", "m")).select(
        "conv_id", "turn", "position", F.col("m.role").alias("role"), F.col("m.text").alias("text")
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: code point ranges [start, start + length) of the trained role's texts."""
    order = [F.col("turn").asc_nulls_first(), F.col("position").asc()]
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    pieces = messages.select(
        "conv_id", "turn", "position", (F.coalesce("role", F.lit("")) == trained_role).alias("trained"),
        F.concat(F.lit(TURN), role, F.lit(TEXT)).alias("head"), text.alias("body"),
    ).withColumn("size", F.length("head") + F.length("body") + len(END))
    by = Window.partitionBy("conv_id").orderBy(*order)
    placed = pieces.withColumn("n", F.row_number().over(by)).withColumn(
        "at", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    span = F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    whole = F.sort_array(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"))))
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(whole, lambda x: x["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), span))).alias("loss_spans"),
    )


def format_conversations(log: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """The rendered conversations of an event log."""
    return render(fold_events(log), trained_role)


def parse(formatted: Column) -> Column:
    """The messages of a rendered conversation: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: F.length(p) > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, TEXT) + len(TEXT))).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
