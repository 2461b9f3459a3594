"""Chat formatting by event-sourced reconstruction; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    r"""Control strings can't occur afterwards: \ becomes \\, # becomes \#, and </ becomes <\/."""
    t = F.regexp_replace(text, r"([\\#])", r"\\$1")
    return F.replace(t, F.lit("</"), F.lit("<\\/"))


def escape_role(role: Column) -> Column:
    """As escape; a colon, which ends the role, is escaped too."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/:])", "$1")


def messages_as_events(messages: DataFrame) -> DataFrame:
    """A table of whole messages (conv_id, turn, role, text) as the log of a chat that streamed them: an opening event, a
    draft, its regeneration (assistant) or edit (others), and two streamed deltas.

    Order within a conversation: turn, then role, then text; nulls first. Null role or text: empty. Repeated rows
    are turns of their own. Other columns are left out.
    """
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    rows = rows.select("conv_id", F.posexplode("rows").alias("message", "row"))
    half = F.floor(F.length("row.text") / 2).cast("int")
    first, second = F.substring("row.text", F.lit(1), half), F.substring("row.text", half + 1, F.length("row.text"))
    spoken, nothing = F.col("row.role") == "assistant", F.lit(None).cast("string")
    event = lambda k, kind, role, text: F.struct((F.col("message") * 5 + k).cast("long").alias("seq"), kind.alias("kind"), role.alias("role"), text.alias("text"))
    return rows.select("conv_id", F.col("message").cast("long").alias("message"), F.explode(F.array(
        event(0, F.lit("message"), F.col("row.role"), nothing),
        event(1, F.lit("delta"), nothing, second),
        event(2, F.when(spoken, "regenerate").otherwise("edit"), nothing, F.when(~spoken, first)),
        event(3, F.lit("delta"), nothing, F.when(spoken, first)),
        event(4, F.lit("delta"), nothing, second),
    )).alias("e")).select("conv_id", "message", "e.*")


def fold_events(events: DataFrame) -> DataFrame:
    """Log rows (conv_id, message, seq, kind, role, text) to one row per conversation: conv_id, turns array<role, text>.

    kind: message opens a message; delta adds text; edit and regenerate replace all text so far; delete takes the
    message out. Other kinds and a null kind count as delta. The last role that isn't null holds. Events of equal seq
    fold in the order of kind, role, text. Exact repeats of an event (redelivery) count once when they share a seq.
    Messages come in the order of their first event. All events of a conversation meet in one row, as its rendered
    text must; conversations are spread by conv_id alone.
    """
    event = F.struct("seq", "kind", "role", "text")
    by_message = events.repartition("conv_id").groupBy("conv_id", "message").agg(F.array_distinct(F.sort_array(F.collect_list(event))).alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["kind"].isin(*RESETS, "delete"), i))
    since = F.coalesce(F.array_max(resets), F.lit(0))
    text = F.array_join(F.transform(F.slice("e", since + 1, F.size("e")), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull())
    gone = F.exists(F.slice("e", since + 1, 1), lambda x: x["kind"] == "delete")
    message = by_message.select("conv_id", F.element_at("e", 1)["seq"].alias("first"), "message", F.struct(
        F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise("").alias("role"), text.alias("text")).alias("turn"), gone.alias("gone"))
    kept = F.filter(F.sort_array(F.collect_list(F.struct("first", "message", "turn", "gone"))), lambda m: ~F.coalesce(m["gone"], F.lit(False)))
    return message.groupBy("conv_id").agg(F.transform(kept, lambda m: m["turn"]).alias("turns"))


def render(conversations: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds formatted, and loss_spans array<start, stop> (characters from 0, stop past the end): the text to train on."""
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(BETWEEN)).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*train_roles).alias("train")))
    df = conversations.withColumn("_pieces", pieces)
    df = df.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    spans = F.aggregate(
        "_pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("at"),
            F.when(p["train"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("stop"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return df.withColumn("loss_spans", spans["spans"]).drop("_pieces")


def parse(formatted: Column) -> Column:
    """The turns array<role, text> of a rendered text."""
    parts = F.split(formatted, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    head = r"^### ([^\\:]*+(?:\\.[^\\:]*+)*+): "  # possessive, so that a long role needs no deep stack
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
