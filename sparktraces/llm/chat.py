"""Chat formatting with rotated perspectives: every participant's view of a dialogue, as training text with masks.

For each participant the dialogue is rendered with that speaker as assistant and the others as named users; system
turns stay system turns and have no view of their own. A rendered dialogue is a table of pieces with their character offsets
in it, so a dialogue of any length is never one string or one task: offsets are running sums over blocks of turns, over
the turns of a block, and inside a turn, each pre-aggregated before the shuffle.

Defined results. A null text counts as empty. A turn without role is spoken by an unnamed user and gives no view.
Turns without a conversation form one dialogue; those without a number come first. Turns with one number are ordered by a digest
of speaker and text; turns that repeat in all columns stand next to each other, as often as they occur. A dialogue without
participants, or an empty table, gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
#: Turn numbers of a block of the running sums.
BLOCK_TURNS = 64


def header(role: Column, viewer: Column, context: tuple[str, ...]) -> Column:
    """The opening mark of a turn as ``viewer`` sees it."""
    named = F.when(role.isNull(), F.lit("<|user|>\n")).otherwise(F.concat(F.lit("<|user:"), role, F.lit("|>\n")))
    return F.when(role == viewer, F.lit("<|assistant|>\n")).when(role.isin(*context), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(named)


def _before(sums: DataFrame, groups: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """``sums`` with the total of ``size`` over the earlier rows of the group."""
    window = Window.partitionBy(*groups).orderBy(*[F.col(o).asc_nulls_first() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(size).over(window), F.lit(0)))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Null-safe join that brings one column along."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], value)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, on).drop(*[f"_r_{k}" for k in keys])


def perspectives(
    turns: DataFrame,
    *,
    context: tuple[str, ...] = ("system",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, perspective, turn, speaker, piece, begin, finish, learn_begin, learn_end) for each view and turn.

    ``begin`` and ``finish`` are the character span of the piece in the rendered dialogue. The learnt span, null for all but the
    viewer's own turns, holds the text and its end mark but not the opening mark.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("said")
    )
    views = rows.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("in"), F.col("speaker").alias("perspective")).distinct()
    rows = rows.groupBy("conv_id", "turn", "speaker", "said").agg(F.count("*").alias("times"))
    seen = rows.join(views, F.col("conv_id").eqNullSafe(F.col("in"))).drop("in")
    head = header(F.col("speaker"), F.col("perspective"), context)
    digest = F.md5(F.concat_ws("|", F.coalesce("speaker", F.lit("")), "said"))
    seen = seen.withColumn("head", head).withColumn("digest", digest).withColumn("slot", F.substring("digest", 1, 1))
    seen = seen.withColumn("length", F.length("head") + F.length("said") + len(END)).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    seen = seen.withColumn("all", F.col("length") * F.col("times"))
    view, place = ["conv_id", "perspective"], ["turn", "slot"]
    slots = seen.groupBy(*view, "block", *place).agg(F.sum("all").alias("all"))
    blocks = slots.groupBy(*view, "block").agg(F.sum("all").alias("all"))
    blocks = _before(blocks, view, ["block"], "all", "blocks_before")
    slots = _joined(_before(slots, [*view, "block"], place, "all", "slots_before"), blocks, [*view, "block"], "blocks_before")
    slots = slots.withColumn("before", F.col("blocks_before") + F.col("slots_before"))
    seen = _joined(_before(seen, [*view, *place], ["digest", "speaker", "said"], "all", "inside"), slots, [*view, *place], "before")
    copies = seen.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    copies = copies.withColumn("begin", F.col("before") + F.col("inside") + F.col("copy") * F.col("length"))
    own = F.col("speaker") == F.col("perspective")
    return copies.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        F.concat("head", "said", F.lit(END)).alias("piece"),
        F.col("begin").cast("long").alias("begin"),
        (F.col("begin") + F.col("length")).cast("long").alias("finish"),
        F.when(own, F.col("begin") + F.length("head")).cast("long").alias("learn_begin"),
        F.when(own, F.col("begin") + F.col("length")).cast("long").alias("learn_end"),
    )
