"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded Bernoulli copy.

Only DataFrame functions are used. The one table that is ordered as a whole has one row per source.

Defined results. A null or empty text has size 0 and is never taken. A null source is a source of its own
and comes last in code point order. The Bernoulli draw depends on the id and the text alone, so different texts draw apart
under one id, or without an id; rows that repeat in both each count and are each taken by the same decision.
An empty table gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktraces.operators.stage import staged

#: Draws made from one digest: 8 hexadecimal digits each.
DRAWS_PER_DIGEST = 4
DIGESTS = 2


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13; 0 for null."""
    gaps = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    padded = F.concat(F.lit(" "), gaps)
    # a word starts wherever a character that is no space follows a space
    starts = F.length(F.regexp_replace(padded, " [^ ]", "..x")) - F.length(padded)
    return F.coalesce(starts, F.lit(0)).cast("long")


def draws(key: Column, seed: int) -> list[Column]:
    """Uniform numbers in [0, 1) that depend on ``key`` and ``seed`` alone."""
    found = []
    for i in range(DIGESTS):
        digest = F.md5(F.concat(F.lit(f"{seed}:{i}:"), key))
        for j in range(DRAWS_PER_DIGEST):
            part = F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("double")
            found.append(part / F.lit(float(1 << 32)))
    return found


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Target words of each row of (src, source_size): shares by weight, stopped at ``most`` times the size.

    The weights repeat over the sources in code point order, null last. Sharing the excess again by weight
    until none is above its stop ends where the sources that reach it, taken in order of stop over weight,
    are full and one level times the weight holds for the rest.
    """
    by_name = Window.orderBy(F.col("src").isNull(), F.encode("src", "UTF-8"))
    ranked = sizes.withColumn("pos", F.row_number().over(by_name) - 1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(table, F.col("pos") % len(weights) + 1)).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("stop") / F.col("weight"), "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("stop").over(before), F.lit(0.0)).alias("full_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
        F.sum("source_size").over(everything).cast("double").alias("all_words"),
        F.sum("weight").over(everything).alias("all_weight"),
    )
    level = (F.col("all_words") - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before"))
    # the first source, in that order, that does not reach its stop fixes the level for all after it
    filled = filled.withColumn("level", F.when(F.col("stop") > level * F.col("weight"), level))
    first = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return filled.select("src", "source_size", F.when(first.isNull(), F.col("stop")).otherwise(first * F.col("weight")).alias("target"))


def mix_plan(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: float = 3.0,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Each document with (size, source_size, target, rate, copies) and the columns named in ``keep``.

    A document is emitted floor(rate) times, and once more if its draw is below the fraction of the rate.
    Every document has a few draws; each source uses the one draw number whose total comes nearest to its
    target, found in the same aggregation that sums the sizes of the accepted rows. Totals are pre-aggregated
    before the shuffle, so a hot source costs one row per task.
    """
    named = F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("src"))
    found = docs.select(named.alias("_mix"), *keep)
    key = F.concat(F.coalesce(F.col("_mix.id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("_mix.text"), F.lit(""))))
    measured = [F.col("_mix.id").alias("_mix_id"), F.col("_mix.src").alias("_mix_src"), word_count(F.col("_mix.text")).alias("_mix_size")]
    measured.append(F.array(*draws(key, seed)).alias("_mix_u"))
    # words are counted once for the totals; only columns that are kept make the last pass read the texts again
    rows = staged(found.select(*measured))
    drawn = found.select(*keep, *measured) if keep else rows
    sizes = rows.groupBy(F.col("_mix_src").alias("src")).agg(F.sum("_mix_size").alias("source_size"))
    goals = targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate"))
    n = DIGESTS * DRAWS_PER_DIGEST
    same = F.col("_mix_src").eqNullSafe(F.col("src"))
    # one row per source: small by nature, joined without a hint so that Spark weighs its real size
    extra = [F.sum(F.when(F.col("_mix_u")[i] < F.col("part"), F.col("_mix_size")).otherwise(0)).alias(f"e{i}") for i in range(n)]
    tried = rows.join(goals, same).groupBy("src", "source_size", "target", "whole", "part", "rate").agg(*extra)
    misses = [F.struct(F.abs(F.col(f"e{i}") + F.col("whole") * F.col("source_size") - F.col("target")).alias("miss"), F.lit(i).alias("i")) for i in range(n)]
    chosen = tried.select("src", "source_size", "target", "rate", "whole", "part", F.least(*misses)["i"].alias("draw"))
    copies = F.col("whole") + F.when(F.element_at("_mix_u", F.col("draw") + 1) < F.col("part"), 1).otherwise(0)
    return drawn.join(chosen, same).select(
        *keep,
        F.col("_mix_id").alias("mix_id"),
        F.col("_mix_size").alias("size"),
        "source_size",
        "target",
        "rate",
        copies.cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, *, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as the plan says."""
    packed = docs.select(F.struct("*").alias("_mix_row"), F.col(id_col).alias("_mix_key"), F.col(text_col).alias("_mix_text"), F.col(source_col).alias("_mix_from"))
    plan = mix_plan(packed, seed=seed, id_col="_mix_key", text_col="_mix_text", source_col="_mix_from", keep=("_mix_row",), **options)
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return plan.filter("copies > 0").select("_mix_row", times.alias("_mix_copy")).select("_mix_row.*")
