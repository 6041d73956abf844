"""Multi-party chat: every dialogue from the perspective of each participant.

For a perspective, that speaker's turns are the assistant's, other speakers are users with their names, and system
turns stay as they are. Loss masks cover what the assistant says and the mark that ends it.

The unit is a turn: a dialogue of any length is rendered over many tasks, in blocks of turn numbers, with running
offsets. ``dialogues`` joins the turns to whole texts where dialogues fit into rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 1024
SYSTEM = "system"
NOBODY = "unknown"  # the speaker of turns without one
END = "<|end|>\n"


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per turn and participant of its dialogue:

    ``conv_id, perspective, turn, speaker, segment, seg_start, seg_end, mask_start, mask_end``. The segments of a
    perspective, by ``seg_start``, are its text; positions count characters. A turn is masked in (``mask_start`` to
    ``mask_end``) for its own speaker and has null there for all others.

    Speakers other than ``system`` are participants; a dialogue of system turns only has none and gives no rows. Null
    text is empty, a null speaker is ``unknown``, turns go by number (null first), then speaker, then text; repeated
    rows are rendered as often as they occur; rows without a dialogue id form one dialogue. ``<|`` in a text is
    rendered ``<\\|`` and white space in a name ``_``, so that no text can pass for a mark.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit(NOBODY)).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    people = rows.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = people.select(F.col("conv_id").alias("_conv"), "perspective")
    seen = rows.join(own, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    name = F.regexp_replace(F.replace("speaker", F.lit("<|"), F.lit("<\\|")), r"\s", "_")
    head = (
        F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n"))
        .when(F.col("speaker") == F.col("perspective"), F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    )
    body = F.concat(F.replace("text", F.lit("<|"), F.lit("<\\|")), F.lit(END))
    block = F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / BLOCK_TURNS)
    told = seen.withColumns({"_head": F.length(head), "segment": F.concat(head, body), "_block": block})
    told = told.withColumn("_n", F.length("segment"))
    group = ["conv_id", "perspective"]
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = told.groupBy(*group, "_block").agg(F.sum("_n").alias("_sum"))
    blocks = blocks.select(*[F.col(c).alias(f"_k_{c}") for c in (*group, "_block")], F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for c in (*group, "_block"):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(*group, "_block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    mine = F.col("speaker") == F.col("perspective")
    return (
        told.join(blocks, same)
        .withColumn("seg_start", start)
        .select(
            *group,
            "turn",
            "speaker",
            "segment",
            "seg_start",
            (F.col("seg_start") + F.col("_n")).alias("seg_end"),
            F.when(mine, F.col("seg_start") + F.col("_head")).alias("mask_start"),
            F.when(mine, F.col("seg_start") + F.col("_n") - 1).alias("mask_end"),
        )
    )


def dialogues(rendered: DataFrame) -> DataFrame:
    """``conv_id, perspective, text, masks``: whole dialogues with their mask spans, for dialogues that fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("seg_start", "segment", "mask_start", "mask_end")))
    spans = F.filter(F.transform("_parts", lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end"))), lambda s: s["start"].isNotNull())
    return (
        rendered.groupBy("conv_id", "perspective")
        .agg(parts.alias("_parts"))
        .select("conv_id", "perspective", F.array_join(F.transform("_parts", lambda p: p["segment"]), "").alias("text"), spans.alias("masks"))
    )
