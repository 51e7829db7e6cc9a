"""Dialogues of several speakers, rendered from the view of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turns in a piece of a rendered dialogue.
PIECE_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
UNNAMED = "unknown"


def escaped(text: Column) -> Column:
    """Text in which no control mark can occur; :func:`unescaped` undoes it."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _header(role: Column, speaker: Column, context: Sequence[str]) -> Column:
    """The speaker is the assistant, context keeps its role, others are named users."""
    named = F.concat(F.lit("user name="), role)
    shown = F.when(role.isin(*context), role).when(role == speaker, "assistant").otherwise(named)
    return F.concat(F.lit(OPEN), shown, F.lit("\n"))


def perspectives(
    turns: DataFrame, context: Sequence[str] = ("system",), piece_turns: int = PIECE_TURNS
) -> DataFrame:
    """(conv_id, speaker, piece, n_turns, rendered, spans): every speaker's view of a dialogue.

    ``turns`` has (conv_id, turn, role, text). For each role that speaks in a dialogue,
    other than ``context``, the whole dialogue is rendered with its turns as the
    assistant's and those of the others as named users'. ``spans`` are the parts
    [start, stop) of ``rendered`` to train on: the speaker's own texts with their end
    marks. Marks inside texts are escaped.

    A piece has the turns from ``piece_turns`` * piece on; the pieces of a dialogue in
    order are its rendering, and spans count from the piece's start. So a very long
    dialogue is spread over tasks, and texts are shuffled once, whatever the
    number of speakers.

    Null texts are empty; a null role is a speaker named "unknown". Turns without a
    number come last, in a piece of their own that is null. Turns of one number
    are ordered by role and text; equal rows are one turn. Rows without conv_id are
    one dialogue. A dialogue of context alone has no view. Other columns are
    ignored; an empty table gives an empty result.
    """
    role = F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit(UNNAMED))
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        escaped(role).alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    rows = rows.withColumn("piece", F.floor(F.col("turn") / piece_turns).cast("long"))
    told = F.array_sort(F.collect_set(F.struct("turn", "role", "text")))
    pieces = rows.groupBy("conv_id", "piece").agg(told.alias("turns"))
    speakers = rows.filter(~F.col("role").isin(*context))
    speakers = speakers.select("conv_id", F.col("role").alias("speaker")).distinct()
    same = F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))
    views = pieces.alias("p").join(speakers.alias("s"), same)
    views = views.select("p.conv_id", "speaker", "piece", "turns")
    close = f"{CLOSE}\n"

    def shown(turn: Column) -> Column:
        return F.concat(
            _header(turn["role"], F.col("speaker"), context), turn["text"], F.lit(close)
        )

    def further(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_header(turn["role"], F.col("speaker"), context))
        stop = start + F.length(turn["text"]) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        own = turn["role"] == F.col("speaker")
        return F.struct(
            (stop + 1).alias("at"),
            F.when(own, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    empty = F.expr("cast(array() as array<struct<start: int, stop: int>>)")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return views.select(
        "conv_id",
        "speaker",
        "piece",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", shown), "").alias("rendered"),
        F.aggregate("turns", zero, further)["spans"].alias("spans"),
    )
