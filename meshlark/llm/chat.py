"""Chat formatting from event logs, with DataFrame functions only.

A log holds events of messages: a start, streamed deltas, edits, regenerations and
deletions. They are partitioned by conversation and, before that, by message, so that the
deltas of a busy conversation are spread over the tasks; there they are sorted by sequence
and folded. The final messages then meet by conversation, are ordered and rendered. A
conversation is one value of the result, so its messages do come together in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"
#: Reversible escapes. Escaped text holds no "<", so no turn mark can occur inside it, and
#: each backslash in it begins an escape. The order is that of escaping.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
STARTS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def event_log(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", deltas: int = 4, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The log of a chat service that ended in these turns.

    Messages of ``trained_roles`` were streamed, given up half-way, regenerated and streamed
    again in ``deltas`` pieces; all others were posted as a draft and edited. Each row is a
    message of its own, repeated rows too. Null texts and roles are empty. Returns
    ``conv_col``, ``seq`` (turn, number), ``message``, ``kind``, ``role``, ``text``.
    """
    rows = turns.select(F.col(conv_col), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.groupBy(conv_col, "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.select(conv_col, "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    event = lambda i, kind, text: F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), text.alias("text"))
    size = F.greatest(F.ceil(F.length("text") / deltas).cast("int"), F.lit(1))
    pieces = [F.substr(F.col("text"), size * k + 1, size) for k in range(deltas)]
    first, empty = F.left(F.col("text"), F.lit(40)), F.lit("")
    streamed = [event(0, "message", empty), event(1, "delta", first), event(2, "delta", F.reverse(first)), event(3, "regenerate", empty), *(event(4 + k, "delta", x) for k, x in enumerate(pieces))]
    edited = [event(0, "message", F.concat(F.lit("draft: "), first)), event(1, "edit", F.col("text"))]
    events = F.when(F.col("role").isin(*trained_roles), F.array(*streamed)).otherwise(F.array(*edited))
    message = F.struct("turn", "role", F.xxhash64("text").alias("fp"), "copy")
    cut = rows.select(conv_col, "turn", "role", message.alias("message"), F.explode(events).alias("event"))
    return cut.select(conv_col, F.struct("turn", "event.i").alias("seq"), "message", "event.kind", "role", "event.text")


def reconstruct(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq", message_col: str = "message", kind_col: str = "kind", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Final messages of an event log.

    Kinds: ``message`` starts a message, ``delta`` adds text, ``edit`` replaces the text,
    ``regenerate`` replaces it and is followed by new deltas, ``delete`` removes the
    message. A message's place is the lowest sequence number of its events; its role is
    that of its first event. Deltas before any start count from an empty text. An unknown
    or null kind is a ``message``. Null texts and roles are empty. A message whose last
    event is a deletion is gone.

    Exactly repeated events are one delivered twice. Null conversations and messages are
    keys like others. Other columns are not read. Returns ``conv_col``, ``seq``, ``role``,
    ``text``.
    """
    kind = F.when(F.col(kind_col).isin("delta", "delete", *STARTS), F.col(kind_col)).otherwise("message")
    event = F.struct(F.col(seq_col).alias("seq"), kind.alias("kind"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = events.groupBy(conv_col, F.col(message_col).alias("_message")).agg(F.collect_list(event).alias("_all"))
    sorted_ = grouped.select(conv_col, F.array_sort(F.array_distinct("_all")).alias("_events"))
    last = F.coalesce(F.array_max(F.transform("_events", lambda e, i: F.when(e["kind"].isin(*STARTS), i + 1))), F.lit(1))
    folded = sorted_.select(conv_col, "_events", F.slice("_events", last, F.size("_events")).alias("_rest"))
    gone = F.element_at("_events", -1)["kind"] == "delete"
    text = F.array_join(F.transform("_rest", lambda e: F.when(e["kind"] == "delete", "").otherwise(e["text"])), "")
    return folded.filter(~gone).select(conv_col, F.get("_events", F.lit(0))["seq"].alias("seq"), F.get("_events", F.lit(0))["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame, conv_col: str = "conv_id", trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted string a conversation, and the mask of the text to train on.

    A turn is ``<turn>`` role, line feed, text ``</turn>``, role and text escaped. The mask
    is an array of (turn, start, end): code points within that turn's block, marks
    included. Messages are ordered by seq (null first), then role and text. Returns
    ``conv_col``, ``formatted``, ``loss_mask``. A conversation without messages has no row.
    """
    turns = messages.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text"))).alias("_turns"))
    head = lambda m: F.concat(F.lit(OPEN), F.replace(escape(m["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    parts = turns.select(conv_col, F.transform("_turns", lambda m: F.struct(m["role"].isin(*trained_roles).alias("train"), head(m).alias("head"), escape(m["text"]).alias("body"))).alias("_parts"))
    mask = F.transform("_parts", lambda p, i: F.when(p["train"], F.struct(i.alias("turn"), F.length(p["head"]).alias("start"), (F.length(p["head"]) + F.length(p["body"])).alias("end"))))
    return parts.select(conv_col, F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"), F.array_compact(mask).alias("loss_mask"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns and trained texts from formatted conversations: ``turns`` (role, text), ``trained`` (texts)."""
    blocks = F.split("formatted", CLOSE)
    cut = formatted.select(conv_col, "formatted", "loss_mask", F.slice(blocks, F.lit(1), F.size(blocks) - 1).alias("_blocks"))

    def turn(block: Column) -> Column:
        body = F.substring(block, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.length(role) + 2, F.length(body))
        return F.struct(unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    trained = F.transform("loss_mask", lambda s: unescape(F.substr(F.get(F.col("_blocks"), s["turn"]), s["start"] + 1, s["end"] - s["start"])))
    return cut.select(conv_col, "formatted", F.transform("_blocks", turn).alias("turns"), trained.alias("trained"))
