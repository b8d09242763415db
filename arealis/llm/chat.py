"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has a row per event of a conversation, in the order of ``seq``:

* ``message`` sets the whole text of a message (and its role),
* ``delta`` appends streamed text,
* ``edit`` replaces the text so far,
* ``regenerate`` empties a message and every later one of its conversation, which are then streamed anew.

The fold runs per message: an aggregate finds its last reset (message, edit, regenerate), the texts from there on are
joined in order. Only the final assembly brings a conversation's messages together, since the result is one string.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. In texts and roles ``\\`` is doubled, then ``<|`` becomes
``<\\|`` (and a line break in a role ``<\\n``): a single backslash after ``<`` only comes from escaping, so both steps can
be undone, and no text can hold a control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, message, role, text)`` of ``(conv_id, seq, message, kind, role, text)`` events.

    ``message`` is an orderable id of the message in its conversation; messages stand in its order. Null texts are
    empty, unknown kinds count as deltas, equal ``seq`` are taken by kind and text. A message whose last reset was a
    regeneration of an earlier message, with nothing streamed since, is gone. The role is the last one named.
    """
    e = events.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("delta")).alias("kind"), "role",
                      F.coalesce("text", F.lit("")).alias("text"))
    # the latest regeneration of this or an earlier message; one shuffle by conversation serves all steps
    upto = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, 0)
    cleared = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(upto)
    live = e.withColumn("cleared", cleared).filter("cleared is null or seq > cleared")
    place = F.struct("seq", "kind", "text")
    last = F.max(F.when(F.col("kind").isin("message", "edit"), place))
    parts = live.groupBy("conv_id", "message").agg(
        last.alias("reset"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.collect_list(place).alias("parts"))
    later = F.filter(F.array_sort("parts"), lambda p: F.col("reset").isNull() | (p >= F.col("reset")))
    return parts.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"),
                        F.array_join(F.transform(later, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, mask)``: one string per conversation, and where its loss counts.

    ``mask`` has an entry per message: ``start`` and ``length`` in code points, within the message's own part of the
    string, of an assistant's text; length 0 for other roles.
    """
    role, text = escaped_role(F.col("role")), escaped(F.col("text"))
    turns = messages.select(
        "conv_id", "message", F.concat(F.lit(OPEN), role, F.lit("\n"), text).alias("turn"),
        (F.length(role) + len(OPEN) + 1).alias("start"),
        F.when(F.col("role") == "assistant", F.length(text)).otherwise(0).alias("length"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("message", "turn", "start", "length"))).alias("turns"))
    return whole.select(
        "conv_id", F.concat(F.array_join(F.transform("turns", lambda t: t["turn"]), CLOSE), F.lit(CLOSE)).alias(
            "formatted"),
        F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text)`` parsed from the formatted string: roles and texts unescaped, text under the mask."""
    parts = F.split("formatted", "<\\|im_end\\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)  # the string ends with a mark
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    turn = lambda p: F.struct(
        unescaped_role(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescaped(F.regexp_replace(body(p), "^[^\n]*\n", "")).alias("text"))
    under = F.zip_with(parts, "mask", lambda p, m: F.when(
        m["length"] > 0, unescaped(F.substr(p, m["start"] + 1, m["length"]))).otherwise(""))
    return formatted.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"),
                            F.array_join(under, "").alias("loss_text"))


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold the log and render it. Empty logs give no rows; null conversation ids form one conversation."""
    return render(fold_messages(events))


def events_of_turns(rows: DataFrame, order: str = "turn") -> DataFrame:
    """A table of whole turns as a log: each row is a message of its own, also where turns or rows repeat."""
    place = F.struct(order, "role", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    return rows.select("conv_id", place.alias("message"), F.col(order).alias("seq"), F.lit("message").alias("kind"),
                       "role", "text")
