"""Test tables built from rank statistics, with p-values on the finished rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparktraces.operators.cohorts import gate_counts
from sparktraces.operators.quantiles import quantiles
from sparktraces.operators.ranks import BUCKET_ROWS, rank_table, spearman, two_sample_ranks
from sparktraces.operators.stage import BROADCAST_ROWS, staged
from sparktraces.operators.summaries import QUARTILES, replicate_means

#: Rows that one task should join with their ranks.
RANKED_ROWS = 1 << 18


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else student_tail(a, b) for a, b in zip(t, df)])


def chi2_tail(h: float, df: float) -> float:
    """Upper tail of chi-square by the regularised incomplete gamma function."""
    a, x = df / 2, h / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    f = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


@F.pandas_udf(DoubleType())
def chi2_p(h: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_tail(a, b) for a, b in zip(h, df)])


def with_spearman_p(table: DataFrame) -> DataFrame:
    return table.withColumn("p", student_p("t_stat", (F.col("n") - 2).cast("double")))


def _with_ranks(rows: DataFrame, groups: Sequence[str], ranks: DataFrame, values: Mapping[int, Column], n_rows: int) -> DataFrame:
    """Each row's centred rank in every variant, as columns _v0, _v1, ...; NULL where it takes no part.

    Short rank tables are broadcast. Of a longer one the values with many ties are, and the rest meets the rows in tasks of about
    `RANKED_ROWS`, so neither a tied value nor the number of rows fills a task.
    """
    groups = list(groups)
    distinct = {r["_variant"]: (r["count"], r["heavy"]) for r in ranks.groupBy("_variant").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("ties") > BUCKET_ROWS).alias("heavy")).collect()}
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / RANKED_ROWS))
    free = BROADCAST_ROWS
    wide = rows
    for at in sorted(values, key=lambda at: distinct.get(at, (0, 0))):
        name = f"_v{at}"
        count, heavy = distinct.get(at, (0, 0))
        table = ranks.filter(F.col("_variant") == at).select(*groups, F.col("_value").alias("_key"), "ties", F.col("_centred").alias(name))
        wide = wide.withColumn("_key", values[at])
        if count <= free:
            free -= count
            wide = wide.join(F.broadcast(table.drop("ties")), [*groups, "_key"], "left")
            continue
        tied = table.filter(F.col("ties") > BUCKET_ROWS).select(*groups, "_key", F.col(name).alias("_tied"))
        wide = wide.join(F.broadcast(tied) if heavy <= BROADCAST_ROWS else tied, [*groups, "_key"], "left")
        # a row that has its rank, or gets none, goes anywhere
        placed = F.col("_key").isNull() | F.col("_tied").isNotNull()
        for g in groups:
            placed |= F.col(g).isNull()
        # as text, for a join on doubles would shuffle again, into a number of parts of its own
        text = (F.col("_key") + F.lit(0.0)).cast("string")
        on = [*groups, "_text", "_spread"]
        wide = wide.withColumn("_text", text).withColumn("_spread", F.when(placed, F.col("_row") + 1).otherwise(F.lit(0))).repartition(parts, *on)
        # always 0, but no literal, which would leave the join and its layout without the column
        zero = F.least(F.col("ties"), F.lit(0)).cast("long")
        light = table.filter(F.col("ties") <= BUCKET_ROWS).select(*groups, text.alias("_text"), zero.alias("_spread"), name).repartition(parts, *on)
        wide = wide.join(light.hint("merge"), on, "left").withColumn(name, F.coalesce("_tied", name)).drop("_tied", "_spread", "_text")
    return wide


def spearman_matrix(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = (), *, min_n: int = 3) -> DataFrame:
    """Long Spearman matrix (groups, x_name, y_name, n, rho, t_stat) over pairwise-complete rows.

    A column is ranked once for every way in which another column's missing values cut it, so once if nothing is missing, and
    the ranks come to the rows as columns. Each task multiplies its ranks as one matrix, and the products are added: no pair of columns gets rows of its own.
    """
    groups, columns = list(groups), list(columns)
    rows = staged(df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_row", F.monotonically_increasing_id()))
    k = range(len(columns))
    counts = rows.agg(*[F.count_if(F.col(columns[i]).isNotNull() & F.col(columns[j]).isNotNull()).alias(f"{i}_{j}") for i in k for j in k if i <= j], F.count(F.lit(1)).alias("rows")).first()
    both = lambda i, j: counts[f"{min(i, j)}_{max(i, j)}"]
    # columns that miss the same rows are one mask; a mask that takes no row from a column leaves its ranks alone
    mask = [next(j for j in k if both(i, j) == both(i, i) == both(j, j)) for i in k]
    cut = lambda i, j: (i, None if both(i, mask[j]) == both(i, i) else mask[j])
    variants = sorted({cut(i, j) for i in k for j in k}, key=str)
    place = {v: at for at, v in enumerate(variants)}

    def values(i: int, j: int | None):
        return F.col(columns[i]) if j is None else F.when(F.col(columns[j]).isNotNull(), F.col(columns[i]))

    each = F.explode(F.array(*[F.struct(F.lit(at).alias("_variant"), values(i, j).alias("_value")) for (i, j), at in place.items()]))
    long = rows.select(*groups, each.alias("_v")).select(*groups, "_v.*").filter(F.col("_value").isNotNull())
    centred = F.col("_rank") - (F.col("n") + 1) / F.lit(2.0)
    by = [*groups, "_variant"]
    ranks = staged(rank_table(long, by, "_value", rank="_rank").select(*by, "_value", "ties", centred.alias("_centred")))
    size = len(variants)
    names = [f"_v{at}" for at in range(size)]
    wide = _with_ranks(rows, groups, ranks, {at: values(i, j) for (i, j), at in place.items()}, counts["rows"])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            parts = batch.groupby(groups, dropna=False, sort=False) if groups else [((), batch)]
            for key, part in parts:
                ranks = part[names].to_numpy(float)
                there = ~np.isnan(ranks)
                ranks = np.where(there, ranks, 0.0)
                out.append((*key, (ranks.T @ ranks).ravel().tolist(), (there.astype(float).T @ there).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*groups, "_g", "_m"])

    types = "".join(f"`{g}` {rows.schema[g].dataType.simpleString()}, " for g in groups)
    products = wide.select(*groups, *names).mapInPandas(multiply, f"{types}_g array<double>, _m array<double>")
    entries = products.select(*groups, F.posexplode(F.arrays_zip("_g", "_m")).alias("_at", "_e")).groupBy(*groups, "_at")
    entries = entries.agg(F.sum("_e._g").alias("_g"), F.sum("_e._m").alias("_m"))
    pick = lambda column, a, b: F.max(F.when(F.col("_at") == a * size + b, F.col(column)))
    cells = []
    for i in k:
        for j in k:
            if i <= j:
                a, b = place[cut(i, j)], place[cut(j, i)]
                cells.append(F.struct(
                    F.lit(columns[i]).alias("x_name"), F.lit(columns[j]).alias("y_name"), pick("_m", a, b).cast("long").alias("n"),
                    pick("_g", a, b).alias("xy"), pick("_g", a, a).alias("xx"), pick("_g", b, b).alias("yy"),
                ))
    table = entries.groupBy(*groups).agg(F.array(*cells).alias("_c")).select(*groups, F.explode("_c").alias("_c")).select(*groups, "_c.*")
    rho = F.when(F.col("n") >= min_n, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))))
    t_stat = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(0.0))))
    return table.filter("n > 0").withColumn("rho", rho).withColumn("t_stat", t_stat).select(*groups, "x_name", "y_name", "n", "rho", "t_stat")


def rank_triples(df: DataFrame, groups: Sequence[str], x: str, y: str, z: str, *, min_n: int = 5) -> DataFrame:
    """(groups, n, rho_xy, rho_xz, rho_yz, partial) on the rows where all three are present.

    ``partial`` is the rank correlation of x and y with z held; all are NULL below ``min_n`` rows.
    """
    complete = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    matrix = spearman_matrix(complete, [x, y, z], groups, min_n=min_n)
    of = lambda a, b: F.max(F.when((F.col("x_name") == a) & (F.col("y_name") == b), F.col("rho")))
    wide = matrix.groupBy(*groups).agg(F.max("n").alias("n"), of(x, y).alias("rho_xy"), of(x, z).alias("rho_xz"), of(y, z).alias("rho_yz"))
    rest = F.sqrt((1 - F.col("rho_xz") * F.col("rho_xz")) * (1 - F.col("rho_yz") * F.col("rho_yz")))
    return wide.withColumn("partial", F.try_divide(F.col("rho_xy") - F.col("rho_xz") * F.col("rho_yz"), rest))


def correlation_sweep(
    df: DataFrame, specs: Sequence[tuple[str, str, str, Column | None]], groups: Sequence[str] = (), *, min_n: int = 3
) -> DataFrame:
    """One Spearman row per spec (name, x, y, gate) and group, all specs in one pass over the table.

    A gate selects the rows of its spec; a row it rejects is simply not in that pair.
    """
    cases = [
        F.when(
            F.lit(True) if gate is None else F.coalesce(gate, F.lit(False)),
            F.struct(F.lit(name).alias("spec"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")),
        )
        for name, x, y, gate in specs
    ]
    long = df.select(*groups, F.explode(F.array_compact(F.array(*cases))).alias("_p")).select(*groups, "_p.*")
    return spearman(long, [*groups, "spec"], "x", "y", min_n=min_n)


def fitted_trend(df: DataFrame, groups: Sequence[str], x: str, y: str, *, log_y: bool = False) -> DataFrame:
    """Least-squares line with R2 and the half width 1.96 s / sqrt(n) of its band (s: residual SD, ddof 0)."""
    v = F.log10(F.col(y)) if log_y else F.col(y)
    ok = F.col(x).isNotNull() & (F.col(y) > 0 if log_y else F.col(y).isNotNull())
    rows = df.filter(ok).select(*groups, F.col(x).cast("double").alias("_x"), v.alias("_y"))
    out = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
        F.var_pop("_y").alias("_v"),
    )
    return out.withColumn(
        "half_width", 1.96 * F.sqrt(F.greatest(F.col("_v") * (1 - F.col("r2")), F.lit(0.0))) / F.sqrt("n")
    ).drop("_v")


def trend_band(trend: DataFrame, at: Column, *, log_y: bool = False) -> DataFrame:
    """Line and band at ``at``; the log variant is turned back by powers of ten."""
    mid = F.col("slope") * at + F.col("intercept")
    parts = {"fit": mid, "low": mid - F.col("half_width"), "high": mid + F.col("half_width")}
    return trend.select("*", *[(F.pow(F.lit(10.0), v) if log_y else v).alias(k) for k, v in parts.items()])


def arm_table(
    gated: DataFrame, panels: Sequence[str], arm: str, value: str, first: str, second: str, *, min_n: int = 1
) -> DataFrame:
    """Per panel: quartiles and n of each arm, gate counts, U, z and Cliff's delta of retained rows.

    ``gated`` carries the columns of `cohorts.gated`.
    """
    kept = gated.filter("retained")
    stats = quantiles(kept, [*panels, arm], value, QUARTILES, count="n")
    counts = gate_counts(gated, [*panels, arm])
    both = counts.join(stats, [*panels, arm], "left")
    names = ["candidates", "gate_pass", "runaway", "retained", "q25", "median", "q75", "n"]
    wide = both.groupBy(*panels).agg(
        *[F.max(F.when(F.col(arm) == a, F.col(c))).alias(f"{a}_{c}") for a in (first, second) for c in names]
    )
    test = two_sample_ranks(kept, panels, arm, value, first, second, min_n=min_n).drop("n1", "n2")
    return wide.join(test, list(panels), "left")


def kinetics_table(
    rows: DataFrame, descriptors: Sequence[str], panels: Sequence[str], arm: str, first: str, second: str
) -> DataFrame:
    """`arm_table` for several descriptor columns at once: one row per (panel, descriptor)."""
    others = [c for c in rows.columns if c not in descriptors]
    long = rows.select(
        *others,
        F.explode(
            F.array(*[F.struct(F.lit(d).alias("descriptor"), F.col(d).cast("double").alias("_value")) for d in descriptors])
        ).alias("_d"),
    ).select(*others, "_d.*")
    return arm_table(long, [*panels, "descriptor"], arm, "_value", first, second)


def bracket_tests(
    df: DataFrame, panels: Sequence[str], category: str, value: str, pairs: Sequence[tuple[str, str]], *, min_n: int = 2
) -> DataFrame:
    """Mann-Whitney and Cliff's delta for each listed category pair, in one pass over the table."""
    sides = [
        F.when(
            F.col(category).isin(a, b),
            F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.when(F.col(category) == a, "first").otherwise("second").alias("_side")),
        )
        for a, b in pairs
    ]
    long = df.select(*panels, value, F.explode(F.array_compact(F.array(*sides))).alias("_p")).select(*panels, value, "_p.*")
    return two_sample_ranks(long, [*panels, "pair"], "_side", value, "first", "second", min_n=min_n)


def replicate_tests(
    df: DataFrame, category: str, replicate: Sequence[str], value: str, pairs: Sequence[tuple[str, str]], *, min_n: int = 2
) -> DataFrame:
    """`bracket_tests` on replicate means."""
    means = replicate_means(df, [category], replicate, value)
    return bracket_tests(means, [], category, "replicate_mean", pairs, min_n=min_n)
