"""Chat formatting: a dialogue rendered once for every participant, with that speaker as the assistant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = ("system",)  # roles that set the scene and take no part
STRETCH = 1024  # turns that are summed before stretches are
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"  # fixed values: marks of the common chat markup


def rotated(turns: DataFrame, context: Sequence[str] = CONTEXT, stretch: int = STRETCH) -> DataFrame:
    """A row per conversation, perspective and turn: ``piece``, its place in the rendered dialogue, and what is trained on.

    Columns: conv_id, perspective, turn, part, speaker, role, piece, start, end, mask_start, mask_end. For each participant of
    a conversation the speaker's own turns are the assistant's and the others are users named after their role; turns of
    ``context`` roles stay system turns and have no perspective. Pieces joined in order of (turn, part) are the dialogue;
    start and end are their code points there (end exclusive), and mask_start and mask_end, null elsewhere, bound what the
    assistant says, its closing mark included.

    A null role is the participant ``unknown``; a null text is an empty turn; a null turn comes first. Turns that share a
    number go by role, then text; ``part`` tells them apart, and equal ones are both kept. Marks inside a text are broken up
    (a blank after ``<``), so that nothing said can pose as markup. A null conv_id is a conversation of its own. A
    conversation of any length is never gathered: running sums are taken over stretches of turns, then over the stretches. Only
    turns that share one number, or have none, are one window. Long texts stay whole; other columns play no part; an empty table
    gives an empty result.
    """
    said = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"<(?=\|im_(start|end)\|>)", "< ")
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), said.alias("said"))
    block = F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-(1 << 62))).cast("long")
    same = Window.partitionBy("conv_id", "block", "turn").orderBy("speaker", "said")
    numbered = clean.withColumn("block", block).withColumn("part", F.row_number().over(same))
    speakers = clean.where(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = numbered.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker").isin(*context), "system").when(own, "assistant").otherwise("user")
    name = F.when(role == "user", F.concat(F.lit(" name="), F.regexp_replace("speaker", r"[^\p{L}\p{N}_.-]", "_"))).otherwise("")
    head = F.concat(F.lit(OPEN), role, name, F.lit("\n"))
    pieces = seen.select("*", role.alias("role"), F.length(head).alias("head"), F.concat(head, F.col("said"), F.lit(CLOSE)).alias("piece"))
    sized = pieces.withColumn("size", F.length("piece").cast("long")).drop("said")
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "part")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("in_block"))
    run = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
                          F.coalesce(F.sum("in_block").over(run), F.lit(0)).alias("base"))
    local = sized.withColumn("here", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = local.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("base") + F.col("here")
    spoken = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "part", "speaker", "role", "piece", start.alias("start"), (start + F.col("size")).alias("end"),
        F.when(spoken, start + F.col("head")).alias("mask_start"), F.when(spoken, start + F.col("size")).alias("mask_end"))
