"""Chat formatting with perspective rotation, in built-in functions only.

For every participant of a dialogue it is rendered once with that speaker as
the assistant and the others as named users; masks mark what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = "system"
UNNAMED = "unknown"
# Turns rendered into one row; longer dialogues continue in further parts, so
# that no dialogue, however long, has to fit one row or task.
TURNS_PER_PART = 256
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _header(role: Column, speaker: Column) -> Column:
    name = F.when(role == speaker, F.lit("assistant")).when(role == SYSTEM, F.lit("system"))
    shown = F.replace(F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.concat(F.lit(OPEN), F.coalesce(name, F.concat(F.lit("user "), shown)), F.lit(CLOSE))


def perspectives(conversations: DataFrame, *, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row per conversation, speaker and part of (conv_id, turn, role, text).

    Columns: conv_id, speaker, part, n_messages, n_target (characters under the
    mask), rendered, mask (``start:end`` in code points of ``rendered``, comma-
    joined: the assistant's words with their end sign).

    Participants are the roles but ``system``, which every perspective sees; a
    null role is the speaker ``unknown``, a null text is empty. Turns are in
    order of turn, role and text, nulls first (part -1 holds null turns); rows
    that repeat in all four columns count once. ``<|`` in a text is written
    ``< |``, and so is ``|>`` as ``| >`` in a role's header, so that neither can forge a header. A conversation of system turns
    only has no participant and no row. Other columns are not read.
    """
    messages = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit(OPEN), F.lit("< |")).alias("text"),
    ).distinct()
    part = F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(-1)).cast("long")
    parts = (
        messages.groupBy("conv_id", part.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    )
    speakers = messages.filter(F.col("role") != SYSTEM).select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")
    ).distinct()
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def step(state: Column, m: Column) -> Column:
        head = _header(m["role"], F.col("speaker"))
        body = F.concat(m["text"], F.lit(END))
        start = state["at"] + F.char_length(head)
        end = start + F.char_length(body)
        spans = F.when(
            m["role"] == F.col("speaker"),
            F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))),
        ).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    first = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )
    pieces = F.transform(
        "messages", lambda m: F.concat(_header(m["role"], F.col("speaker")), m["text"], F.lit(END))
    )
    spans = F.aggregate("messages", first, step, lambda s: s["spans"])
    return seen.withColumn("spans", spans).select(
        "conv_id",
        "speaker",
        "part",
        F.size("messages").cast("long").alias("n_messages"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_target"),
        F.array_join(pieces, "").alias("rendered"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("mask"),
    )
