"""Least-squares model fits.

Every model is linear in all but one or two shape values.  For each trace and
each shape value of a grid the sums of the normal equations are collected; at most
three linear coefficients are then solved inside their bounds, the best shape
wins, and the grid closes in around it.

`fitted` does all of this, for all models and with the scores, inside one batch of
traces: a single shuffle of the points and one row back per fit.  Only a trace longer
than a chunk takes the other way, where its parts sum on their own, the
sums of the parts are shuffled and added, and each round is a job of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktraces.operators import smoothing
from sparktraces.operators.quantiles import quantiles
from sparktraces.operators.sequence import CHUNK_ROWS, attach, chunk_column, renumber, spread, summarise, with_summary
from sparktraces.operators.stage import lookup_side, staged

FREE = 1e300
SUMS = ["yy", "b1", "b2", "b3", "g11", "g12", "g13", "g22", "g23", "g33"]
QUANTUM = 1e9
SINGULAR = 1e-12
MIN_POINTS = 15
#: Grid points a side, at first and when it closes in, of models with two shape values.
PAIR_GRID, PAIR_REFINE = 24, 9

# Box bounds of the viscoelastic parameters and the bound margin.
E_BOUNDS = (1.0, 100_000.0)
ETA_BOUNDS = (1.0, 500_000.0)
FLOW_BOUNDS = (500.0, 1_000_000.0)
BOUND_MARGIN = 0.02

#: Lower and upper bounds of the three coefficients at given shape values.
Bounds = Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray | float, np.ndarray | float]]]


@dataclass(frozen=True)
class Model:
    """A named family: its basis, number of parameters and bounds of the three coefficients.

    ``dims`` lists the coefficients in use; ``capped`` those that may sit on their upper bound.
    """

    name: str
    basis: str
    n_params: int
    dims: tuple[int, ...]
    bounds: Bounds
    floored: tuple[int, ...] = ()
    capped: tuple[int, ...] = ()

    def patterns(self) -> list[tuple[int, int, int]]:
        """Per coefficient 0 free, 1 at the lower bound, 2 at the upper bound."""
        choices = []
        for k in range(3):
            if k not in self.dims:
                choices.append((1,))
            else:
                choices.append((0,) + ((1,) if k in self.floored else ()) + ((2,) if k in self.capped else ()))
        return list(itertools.product(*choices))


def basis_terms(basis: str, t: Column, s1: Column, s2: Column) -> tuple[Column, Column, Column]:
    if basis == "rise":
        return 1 - F.exp(-t / s1), t, F.lit(1.0)
    if basis == "two_rises":
        return 1 - F.exp(-t / s1), 1 - F.exp(-t / s2), F.lit(0.0)
    if basis == "power":
        return F.pow(t, s1), F.lit(0.0), F.lit(1.0)
    raise ValueError(f"unknown basis {basis}")


ABSENT = (0.0, 0.0)
POSITIVE = (0.0, FREE)


def _rise_bounds(radius_pressure: float, c: float) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Bounds of the rise so that modulus and viscosity stay in their boxes at this time constant."""

    def bounds(tau: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        per_tau = 3 * math.pi / (c * tau)
        e_lo = np.maximum(E_BOUNDS[0], per_tau * ETA_BOUNDS[0])
        e_hi = np.minimum(E_BOUNDS[1], per_tau * ETA_BOUNDS[1])
        return radius_pressure / (c * e_hi), radius_pressure / (c * e_lo)

    return bounds


def viscoelastic_models(radius_pressure: float, c: float) -> list[Model]:
    """Kelvin-Voigt, Jeffreys and Burgers creep under a constant pressure."""
    rise = _rise_bounds(radius_pressure, c)
    flow = (radius_pressure / (3 * math.pi * FLOW_BOUNDS[1]), radius_pressure / (3 * math.pi * FLOW_BOUNDS[0]))
    spring = (radius_pressure / (c * E_BOUNDS[1]), radius_pressure / (c * E_BOUNDS[0]))
    both = dict(floored=(0, 1, 2), capped=(0, 1, 2))
    return [
        Model("Kelvin-Voigt", "rise", 2, (0,), lambda a, b: [rise(a), ABSENT, ABSENT], **both),
        Model("Jeffreys", "rise", 3, (0, 1), lambda a, b: [rise(a), flow, ABSENT], **both),
        Model("Burgers", "rise", 4, (0, 1, 2), lambda a, b: [rise(a), flow, spring], **both),
    ]


LINE = Model("Linear", "line", 2, (1, 2), lambda a, b: [ABSENT, (-FREE, FREE), (-FREE, FREE)])
POWER_LAW = Model("Power-Law", "power", 3, (0, 2), lambda a, b: [POSITIVE, ABSENT, (-FREE, FREE)], floored=(0,))
#: A rise from an offset, with a bounded amplitude and a free base.
EXPONENTIAL = Model("Exponential", "rise", 3, (0, 2), lambda a, b: [POSITIVE, ABSENT, (-FREE, FREE)], floored=(0,))
MONO = Model("Mono", "rise", 2, (0,), lambda a, b: [POSITIVE, ABSENT, ABSENT], floored=(0,))
BI = Model("Bi", "two_rises", 4, (0, 1), lambda a, b: [POSITIVE, POSITIVE, ABSENT], floored=(0, 1))


def fit_points(
    df: DataFrame, keys: Sequence[str], t: str, y: str, *, n_rows: str, min_points: int = MIN_POINTS, frame: str = "frame"
) -> DataFrame:
    """Outlier-free rows of long enough traces: (keys, frame, t, y) with time from the first kept row."""
    clean = smoothing.outlier_free(df, keys, y, n_rows=n_rows, frame=frame).filter("inlier")
    # numbering reads the rows twice, and the medians cost more than writing them
    clean = staged(clean.select(*keys, frame, chunk_column(frame), t, y))
    dense = renumber(clean, keys, frame=frame, n_rows="_n", clock=t, start="_t0")
    kept = dense.filter(F.col("_n") >= min_points)
    return staged(kept.select(*keys, frame, (F.col(t) - F.col("_t0")).alias("t"), F.col(y).alias("y")))


def _grid_value(spec: Column, i: Column, log: bool, second: bool = False) -> Column:
    lo, hi, n = (spec["lo2"], spec["hi2"], spec["n2"]) if second else (spec["lo1"], spec["hi1"], spec["n1"])
    part = i / F.greatest(n - 1, F.lit(1))
    return F.exp(F.ln(lo) + (F.ln(hi) - F.ln(lo)) * part) if log else lo + (hi - lo) * part


def _spec(model: Column, lo1, hi1, n1: int, lo2=None, hi2=None, n2: int = 1) -> Column:
    one = F.lit(1.0)
    return F.struct(
        model.alias("model"), lo1.alias("lo1"), hi1.alias("hi1"), F.lit(n1).alias("n1"),
        (one if lo2 is None else lo2).alias("lo2"), (one if hi2 is None else hi2).alias("hi2"), F.lit(n2).alias("n2"),
    )


def _basis_arrays(basis: str, t: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three basis terms at each (time, shape); terms that do not depend on the shape have one column."""
    one = np.ones((len(t), 1))
    if basis == "rise":
        return -np.expm1(-t[:, None] / s1), t[:, None], one
    if basis == "two_rises":
        return -np.expm1(-t[:, None] / s1), -np.expm1(-t[:, None] / s2), 0 * one
    if basis == "power":
        return np.power(t[:, None], s1), 0 * one, one
    raise ValueError(f"unknown basis {basis}")


def _grid_array(lo: float, hi: float, i: np.ndarray, n: int, log: bool) -> np.ndarray:
    part = i / np.maximum(n - 1, 1)
    return np.exp(np.log(lo) + (np.log(hi) - np.log(lo)) * part) if log else lo + (hi - lo) * part


def _shape_sums(t: np.ndarray, y: np.ndarray, basis: str, s1: np.ndarray, s2: np.ndarray) -> list[np.ndarray | float]:
    """`SUMS` over the given points at each shape value, or for two rises at each pair of ``s1`` and ``s2``.

    A term is worked out once for each shape value, and a sum that has no shape is a number.
    """
    if basis == "two_rises":
        a, b = -np.expm1(-t[:, None] / s1), -np.expm1(-t[:, None] / s2)
        ya, yb = np.repeat(y @ a, len(s2)), np.tile(y @ b, len(s1))
        aa, bb = np.repeat(np.einsum("ij,ij->j", a, a), len(s2)), np.tile(np.einsum("ij,ij->j", b, b), len(s1))
        return [y @ y, ya, yb, 0.0, aa, (a.T @ b).ravel(), 0.0, bb, 0.0, 0.0]
    if basis == "rise":
        a = -np.expm1(-t[:, None] / s1)
        ya, ta, sa = np.stack((y, t, np.ones(len(t)))) @ a
        return [y @ y, ya, y @ t, y.sum(), np.einsum("ij,ij->j", a, a), ta, sa, t @ t, t.sum(), len(t)]
    if basis == "power":
        a = np.power(t[:, None], s1)
        ya, sa = np.stack((y, np.ones(len(t)))) @ a
        return [y @ y, ya, 0.0, y.sum(), np.einsum("ij,ij->j", a, a), 0.0, sa, 0.0, 0.0, len(t)]
    raise ValueError(f"unknown basis {basis}")


def _partial_sums(t: np.ndarray, y: np.ndarray, spec: Mapping, basis: str, log: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Grid positions, and the products of the normal equations summed over the given points at each of them."""
    i = np.arange(spec["n1"] * spec["n2"])
    s1 = _grid_array(spec["lo1"], spec["hi1"], np.arange(spec["n1"]), spec["n1"], log)
    s2 = _grid_array(spec["lo2"], spec["hi2"], np.arange(spec["n2"]), spec["n2"], log)
    sums = [np.broadcast_to(x, len(i)) for x in _shape_sums(t, y, basis, s1, s2)]
    if basis == "two_rises":
        able = s1[i // spec["n2"]] < s2[i % spec["n2"]]
        i, sums = i[able], [x[able] for x in sums]
    return i, sums


def _sums(points: DataFrame, keys: Sequence[str], specs: DataFrame, basis: str, log: bool) -> DataFrame:
    """Normal-equation sums per (trace, spec, grid point).

    A task sums the points that it holds of a trace over the whole grid at once, so no point is repeated; the parts of
    a trace are added afterwards.
    """
    keys = list(keys)
    # A merge join keeps the spread of the points, and leaves the rows of a trace next to each other.
    placed = attach(points, specs.hint("merge"), keys, how="inner").select(*keys, "t", "y", "_specs")
    key_types = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, "_k", "_i", *SUMS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for key, rows in batch.groupby(keys, sort=False, dropna=False):
                t, y = rows["t"].to_numpy(), rows["y"].to_numpy()
                for k, spec in enumerate(rows["_specs"].iloc[0]):
                    i, sums = _partial_sums(t, y, spec, basis, log)
                    parts.append(pd.DataFrame(dict(zip(columns, [*key, k, i, *sums]))))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=columns)

    schema = f"{key_types}, _k int, _i int, " + ", ".join(f"{n} double" for n in SUMS)
    sums = placed.mapInPandas(run, schema).groupBy(*keys, "_k", "_i").agg(*[F.sum(n).alias(n) for n in SUMS])
    spec = F.col("_s")
    # The grid itself is not grouped on: a row finds its spec again by position.
    return sums.join(specs.drop("_last"), keys).withColumn("_s", F.col("_specs")[F.col("_k")]).select(
        *keys, "_i", "_s", *SUMS, *_shapes(spec, log)
    )


def _shapes(spec: Column, log: bool) -> tuple[Column, Column]:
    i = F.col("_i")
    return (
        _grid_value(spec, F.floor(i / spec["n2"]), log).alias("s1"),
        _grid_value(spec, i % spec["n2"], log, True).alias("s2"),
    )


def bounded_least_squares(sums: pd.DataFrame, box: pd.DataFrame, patterns: Sequence[tuple[int, int, int]]) -> pd.DataFrame:
    """(rss, c1, c2, c3) per row: the best least-squares coefficients inside the box.

    Each pattern of free and pinned coefficients is solved in closed form for all
    rows at once; the feasible one with the least residual is the bounded optimum.
    """
    rss, c = _box_least_squares([sums[x].to_numpy() for x in SUMS], [box[f"lo{k}"].to_numpy() for k in (1, 2, 3)], [box[f"hi{k}"].to_numpy() for k in (1, 2, 3)], patterns)
    return pd.DataFrame({"rss": rss, "c1": c[0], "c2": c[1], "c3": c[2]})


def _pair_solved(m: Sequence[np.ndarray], r: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both unknowns of a symmetric system (m11, m12, m22) by elimination with the larger pivot, and the size of its determinant."""
    swap = np.abs(m[1]) > np.abs(m[0])
    p, q = np.where(swap, m[1], m[0]), np.where(swap, m[2], m[1])
    u, v = np.where(swap, m[0], m[1]), np.where(swap, m[1], m[2])
    first, second = np.where(swap, r[1], r[0]), np.where(swap, r[0], r[1])
    factor = u / p
    rest = v - factor * q
    y = (second - factor * first) / rest
    return (first - q * y) / p, y, np.abs(p * rest)


def _box_least_squares(
    sums: Sequence[np.ndarray], lo: Sequence[np.ndarray], hi: Sequence[np.ndarray], patterns: Sequence[tuple[int, int, int]]
) -> tuple[np.ndarray, list[np.ndarray]]:
    """`bounded_least_squares` from columns: the residuals and the three coefficients."""
    yy, b = sums[0], sums[1:4]
    named = dict(zip(SUMS, sums))
    g = [[named[f"g{min(i, j)}{max(i, j)}"] for j in (1, 2, 3)] for i in (1, 2, 3)]
    floor, roof = [x - np.abs(x) * 1e-9 for x in lo], [x + np.abs(x) * 1e-9 for x in hi]
    best_rss, best_c = np.full(len(yy), np.inf), [np.full(len(yy), np.nan) for _ in range(3)]
    for pattern in patterns:
        free = [k for k in range(3) if not pattern[k]]
        pinned = [k for k in range(3) if pattern[k]]
        c = [None if k in free else (lo if pattern[k] == 1 else hi)[k] for k in range(3)]
        r = {}
        for k in free:
            r[k] = b[k]
            for j in pinned:
                r[k] = r[k] - g[k][j] * c[j]
        scale = np.ones(len(yy))
        for k in free:
            scale = scale * g[k][k]
        with np.errstate(all="ignore"):
            if len(free) == 1:
                (k,) = free
                c[k], size = r[k] / g[k][k], np.abs(g[k][k])
            elif len(free) == 2:
                k, j = free
                c[k], c[j], size = _pair_solved((g[k][k], g[k][j], g[j][j]), (r[k], r[j]))
            elif free:
                m = np.stack([np.stack(row, axis=-1) for row in g], axis=-2)
                size = np.abs(np.linalg.det(m))
                ok = size > SINGULAR * scale
                found = np.full((len(yy), 3), np.nan)
                found[ok] = np.linalg.solve(m[ok], np.stack([r[k] for k in free], axis=-1)[ok][:, :, None])[:, :, 0]
                c = list(found.T)
            inside = size > SINGULAR * scale if free else np.ones(len(yy), bool)
            for k in range(3):
                inside = inside & (c[k] >= floor[k]) & (c[k] <= roof[k])
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        x = [v[at] for v in c]
        square = sum(x[k] * x[k] * g[k][k][at] for k in range(3)) + 2 * (x[0] * x[1] * g[0][1][at] + x[0] * x[2] * g[0][2][at] + x[1] * x[2] * g[1][2][at])
        rss = np.maximum(yy[at] - 2 * sum(x[k] * b[k][at] for k in range(3)) + square, 0.0)
        better = rss < best_rss[at]
        at = at[better]
        best_rss[at] = rss[better]
        for k in range(3):
            best_c[k][at] = x[k][better]
    return best_rss, best_c


def _box(model: Model, s1: np.ndarray, s2: np.ndarray) -> pd.DataFrame:
    n = len(s1)
    bounds = model.bounds(s1, s2)
    return pd.DataFrame({f"{side}{k + 1}": np.broadcast_to(bounds[k][j], n) for j, side in enumerate(("lo", "hi")) for k in range(3)})


def _solver(models: Sequence[Model]):
    known = {m.name: m for m in models}

    @F.pandas_udf("rss double, c1 double, c2 double, c3 double")
    def solve(name: pd.Series, sums: pd.DataFrame, s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
        parts = []
        for m, i in name.groupby(name).groups.items():
            box = _box(known[m], s1.loc[i].to_numpy(), s2.loc[i].to_numpy())
            parts.append(bounded_least_squares(sums.loc[i], box, known[m].patterns()).set_index(i))
        return pd.concat(parts).sort_index()

    return solve


def _best(sums: DataFrame, keys: Sequence[str], models: Sequence[Model]) -> DataFrame:
    """Best grid point of each model per trace; residuals equal to nine digits count as ties."""
    asked = F.col("_s.model")
    names = F.array_compact(F.array(*[F.when(asked.isin("*", m.name), F.lit(m.name)) for m in models]))
    rows = sums.withColumn("model", F.explode(names))
    solved = rows.withColumn("_fit", _solver(models)("model", F.struct(*SUMS), "s1", "s2"))
    rank = F.struct(F.floor(F.try_divide(F.col("_fit.rss"), F.col("yy")) * QUANTUM + 0.5), F.col("_i"))
    return solved.groupBy(*keys, "model").agg(
        F.min_by(F.struct("_i", "s1", "s2", "_s", "_fit"), rank).alias("_win")
    ).select(*keys, "model", "_win.*")


def _closer(best: DataFrame, keys: Sequence[str], log: bool, n1: int, n2: int) -> DataFrame:
    """Grid specs from one step below to one step above each winner, gathered per trace."""
    s = F.col("_s")
    i1, i2 = F.floor(F.col("_i") / s["n2"]), F.col("_i") % s["n2"]

    def near(i: Column, n: Column, second: bool) -> tuple[Column, Column]:
        return (
            _grid_value(s, F.greatest(i - 1, F.lit(0)), log, second),
            _grid_value(s, F.least(i + 1, F.greatest(n - 1, F.lit(0))), log, second),
        )

    lo1, hi1 = near(i1, s["n1"], False)
    lo2, hi2 = near(i2, s["n2"], True)
    return best.groupBy(*keys).agg(F.collect_list(_spec(F.col("model"), lo1, hi1, n1, lo2, hi2, n2)).alias("_specs"))


def fit_models(
    points: DataFrame, keys: Sequence[str], models: Sequence[Model], *, grid: int = 96, refine: int = 33, rounds: int = 2
) -> DataFrame:
    """(keys, model, s1, s2, c1, c2, c3, rss) for models that share a basis.

    The first grid covers dt/3 .. 30 T for time constants and 0 .. 2 for exponents;
    each further round spans the neighbours of the winner.
    """
    basis = models[0].basis
    log = basis != "power"
    pair = basis == "two_rises"
    first_n, next_n = (PAIR_GRID, PAIR_REFINE) if pair else (grid, refine)
    star = F.lit("*")
    span = F.max("t") - F.min("t")
    lo = span / (F.count(F.lit(1)) - 1) / 3
    if basis == "power":
        specs = F.array(_spec(star, F.lit(0.0), F.lit(2.0), first_n))
    elif pair:
        specs = F.array(_spec(star, lo, 30 * span, first_n, lo, 30 * span, first_n))
    else:
        specs = F.array(_spec(star, lo, 30 * span, first_n))
    points = spread(points, keys)
    ends = summarise(points, keys, specs.alias("_specs"))
    last = ends.select(*keys, "_last")
    best = _best(_sums(points, keys, ends, basis, log), keys, models)
    for _ in range(rounds):
        closer = _closer(best, keys, log, next_n, next_n if pair else 1).join(last, list(keys))
        best = _best(_sums(points, keys, closer, basis, log), keys, models)
    return staged(
        best.select(
            *keys, "model", "s1", "s2", F.col("_fit.c1").alias("c1"), F.col("_fit.c2").alias("c2"),
            F.col("_fit.c3").alias("c3"), F.col("_fit.rss").alias("grid_rss"),
        )
    )


def fit_lines(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Straight lines in the same shape as `fit_models`: slope in c2, intercept in c3."""
    return points.groupBy(*keys).agg(
        F.lit("Linear").alias("model"),
        F.lit(1.0).alias("s1"),
        F.lit(1.0).alias("s2"),
        F.lit(0.0).alias("c1"),
        F.regr_slope("y", "t").alias("c2"),
        F.regr_intercept("y", "t").alias("c3"),
    )


def predict(model: Column, t: Column, fit: Column | None = None) -> Column:
    """Model value at ``t`` from fit columns (or a struct holding them)."""
    s1, s2, c1, c2, c3 = (F.col(n) if fit is None else fit[n] for n in ("s1", "s2", "c1", "c2", "c3"))

    def value(basis: str) -> Column:
        g1, g2, g3 = basis_terms(basis, t, s1, s2)
        return c1 * g1 + c2 * g2 + c3 * g3

    return (
        F.when(model == "Linear", c2 * t + c3)
        .when(model == "Power-Law", value("power"))
        .when(model == "Bi", value("two_rises"))
        .otherwise(value("rise"))
    )


def aicc(rss: Column, n: Column, dw: Column, k: Column) -> Column:
    """AICc whose correction term uses an effective n reduced by the residual autocorrelation."""
    n = n.cast("double")
    rho = F.coalesce(1 - dw / 2, F.lit(0.0))
    n_eff = F.when(rho == -1, n).otherwise(n * (1 - rho) / F.nullif(1 + rho, F.lit(0.0)))
    n_eff = F.greatest(k + 2.0, F.least(n, n_eff))
    return n * F.ln(F.greatest(rss, F.lit(1e-12)) / n) + 2 * k + 2 * k * (k + 1) / (n_eff - k - 1)


def aic(rss: Column, n: Column, k: Column) -> Column:
    return n * F.ln(F.greatest(rss, F.lit(1e-12)) / n) + 2 * k


# Parameters counted per model.
N_PARAMS = {"Linear": 2, "Power-Law": 3, "Kelvin-Voigt": 2, "Jeffreys": 3, "Burgers": 4, "Mono": 2, "Bi": 4, "Exponential": 3}


def assess(points: DataFrame, keys: Sequence[str], fits: DataFrame) -> DataFrame:
    """Adds n, rss, dw, r2, aicc and aic from the ordered residuals of each fit."""
    columns = ["model", "s1", "s2", "c1", "c2", "c3"]
    gathered = fits.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_fits"))
    ends = summarise(points, keys, (F.var_pop("y") * F.count("y")).alias("_sst")).join(gathered, list(keys))
    rows = (
        attach(points, ends, keys, how="inner")
        .withColumn("_fit", F.explode("_fits"))
        .select(*keys, "frame", "y", "_sst", F.col("_fit.model").alias("model"), predict(F.col("_fit.model"), F.col("t"), F.col("_fit")).alias("_p"))
        .withColumn("_e", F.col("y") - F.col("_p"))
    )
    by = [*keys, "model"]
    sst = ends.select(*keys, "_sst")
    scored = smoothing.durbin_watson(rows, by, "_e").join(sst, list(keys))
    k = F.create_map(*[F.lit(x) for pair in N_PARAMS.items() for x in pair])[F.col("model")].cast("double")
    return fits.join(
        scored.select(
            *by,
            "n",
            "rss",
            "dw",
            F.when(F.col("_sst") > 1e-12, 1 - F.col("rss") / F.nullif(F.col("_sst"), F.lit(0.0))).otherwise(0.0).alias("r2"),
            aicc(F.col("rss"), F.col("n"), F.col("dw"), k).alias("aicc"),
            aic(F.col("rss"), F.col("n"), k).alias("aic"),
        ),
        by,
    )


#: Points of a batch of traces, on average.
BATCH_POINTS = 50_000
SCORED = "model string, s1 double, s2 double, c1 double, c2 double, c3 double, n long, rss double, dw double, r2 double, aicc double, aic double"


@dataclass
class _Grid:
    """A grid of shape values for one trace."""

    lo1: float
    hi1: float
    n1: int
    lo2: float = 1.0
    hi2: float = 1.0
    n2: int = 1

    def around(self, i: int, log: bool, n1: int, n2: int) -> _Grid:
        """From one step below to one step above a grid point."""

        def near(lo: float, hi: float, n: int, at: int) -> tuple[float, float]:
            ends = np.array([max(at - 1, 0), min(at + 1, max(n - 1, 0))])
            return tuple(_grid_array(lo, hi, ends, n, log))

        return _Grid(*near(self.lo1, self.hi1, self.n1, i // self.n2), n1, *near(self.lo2, self.hi2, self.n2, i % self.n2), n2)


#: Traces that are solved at a time.
SOLVED_TRACES = 256


def _solved(traces: Sequence[tuple[np.ndarray, np.ndarray]], grids: Sequence[_Grid], models: Sequence[Model]) -> list[dict[int, tuple]]:
    """For each model the best grid point of each trace: (grid position, s1, s2, c1, c2, c3). The grids have one shape."""
    basis, log = models[0].basis, models[0].basis != "power"
    n1, n2 = grids[0].n1, grids[0].n2
    i = np.arange(n1 * n2)
    out: list[dict[int, tuple]] = [{} for _ in models]
    for start in range(0, len(traces), SOLVED_TRACES):
        some = traces[start : start + SOLVED_TRACES]
        lo1, hi1, lo2, hi2 = (np.array([getattr(x, f) for x in grids[start : start + SOLVED_TRACES]])[:, None] for f in ("lo1", "hi1", "lo2", "hi2"))
        first, second = _grid_array(lo1, hi1, np.arange(n1), n1, log), _grid_array(lo2, hi2, np.arange(n2), n2, log)
        table = np.empty((len(SUMS), len(some), len(i)))
        for o, (t, y) in enumerate(some):
            for column, x in zip(table, _shape_sums(t, y, basis, first[o], second[o])):
                column[o] = x
        s1, s2 = first[:, i // n2].ravel(), second[:, i % n2].ravel()
        sums = table.reshape(len(SUMS), -1)
        yy = sums[0]
        absent = ~(s1 < s2) if basis == "two_rises" else np.zeros(len(s1), bool)
        for found, model in zip(out, models):
            bounds = [tuple(np.broadcast_to(x, len(s1)) for x in side) for side in model.bounds(s1, s2)]
            rss, c = _box_least_squares(sums, [x[0] for x in bounds], [x[1] for x in bounds], model.patterns())
            rank = np.floor(np.divide(rss, yy, out=np.zeros_like(yy), where=yy > 0) * QUANTUM + 0.5)
            rank[absent] = np.inf
            # the least position wins among equals
            win = rank.reshape(len(some), -1).argmin(axis=1)
            at = np.arange(len(some)) * len(i) + win
            for o in np.flatnonzero(np.isfinite(rss[at]) & ~absent[at]).tolist():
                f = at[o]
                found[start + o] = (int(win[o]), s1[f], s2[f], *(x[f] for x in c))
    return out


def _first_grid(t: np.ndarray, basis: str, grid: int) -> _Grid:
    span = t.max() - t.min()
    lo = span / (len(t) - 1) / 3
    if basis == "power":
        return _Grid(0.0, 2.0, grid)
    return _Grid(lo, 30 * span, PAIR_GRID, lo, 30 * span, PAIR_GRID) if basis == "two_rises" else _Grid(lo, 30 * span, grid)


def _line(t: np.ndarray, y: np.ndarray) -> tuple | None:
    dt = t - t.mean()
    if not (dt @ dt) > 0:
        return None
    slope = (dt @ (y - y.mean())) / (dt @ dt)
    return 1.0, 1.0, 0.0, slope, y.mean() - slope * t.mean()


def fit_together(traces: Sequence[tuple[np.ndarray, np.ndarray]], models: Sequence[Model], *, grid: int, refine: int, rounds: int) -> list[dict[str, tuple]]:
    """(s1, s2, c1, c2, c3) of each model for each trace (t, y), all traces solved at once; a fit that fails is left out."""
    out: list[dict[str, tuple]] = [{} for _ in traces]
    for basis, family in itertools.groupby(sorted(models, key=lambda m: m.basis), key=lambda m: m.basis):
        family = list(family)
        if basis == "line":
            for fits, (t, y) in zip(out, traces):
                if (found := _line(t, y)) is not None:
                    fits[family[0].name] = found
            continue
        log, pair = basis != "power", basis == "two_rises"
        able = [o for o, (t, _) in enumerate(traces) if len(t) > 1 and t.max() > t.min()]
        if not able:
            continue
        grids = [_first_grid(traces[o][0], basis, grid) for o in able]
        best = _solved([traces[o] for o in able], grids, family)
        for model, found in zip(family, best):
            mine = {able[k]: (grids[k], w) for k, w in found.items()}
            for _ in range(rounds):
                near = {o: g.around(w[0], log, *((PAIR_REFINE, PAIR_REFINE) if pair else (refine, 1))) for o, (g, w) in mine.items()}
                if not near:
                    break
                (again,) = _solved([traces[o] for o in near], list(near.values()), [model])
                mine = {o: (near[o], again[k]) for k, o in enumerate(near) if k in again}
            for o, (_, w) in mine.items():
                out[o][model.name] = w[1:]
    return out


def _scores(t: np.ndarray, y: np.ndarray, name: str, basis: str, fit: tuple) -> tuple:
    """(n, rss, dw, r2, aicc, aic) of one fit over the ordered points of a trace."""
    s1, s2, c1, c2, c3 = fit
    if basis == "line":
        value = c2 * t + c3
    else:
        a, b, c = (g[:, 0] for g in _basis_arrays(basis, t, np.array([s1]), np.array([s2])))
        value = c1 * a + c2 * b + c3 * c
    e = y - value
    n, rss, k = len(y), float(e @ e), N_PARAMS[name]
    steps = np.diff(e)
    dw = float(steps @ steps) / rss if n >= 2 and rss >= 1e-15 else None
    sst = float(((y - y.mean()) ** 2).sum())
    r2 = 1 - rss / sst if sst > 1e-12 else 0.0
    rho = 1 - dw / 2 if dw is not None else 0.0
    n_eff = n if rho == -1 else n * (1 - rho) / (1 + rho)
    n_eff = max(k + 2.0, min(n, n_eff))
    plain = n * math.log(max(rss, 1e-12) / n) + 2 * k
    left = n_eff - k - 1
    return n, rss, dw, r2, plain + 2 * k * (k + 1) / left, plain


def fitted(
    points: DataFrame, keys: Sequence[str], models: Sequence[Model] | Mapping[str, Sequence[Model]], *, by: str | None = None,
    grid: int = 96, refine: int = 33, rounds: int = 2,
) -> DataFrame:
    """(keys, model, s1, s2, c1, c2, c3, n, rss, dw, r2, aicc, aic): all fits of all traces, with their scores.

    ``points`` holds (keys, frame, t, y).  With ``by``, one of the keys, ``models`` maps its values to lists of models, so
    points of several kinds go through together.  A fit without a solution gives no row.
    """
    keys = list(keys)
    chosen = {None: list(models)} if by is None else {value: list(m) for value, m in models.items()}
    sizes = staged(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total, longest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    short = points.select(*keys, "frame", "t", "y")
    if longest is not None and longest > CHUNK_ROWS:
        long = lookup_side(sizes.filter(F.col("_n") > CHUNK_ROWS).select(*keys))
        short = short.join(long, keys, "left_anti")
    batches = max(1, math.ceil((total or 0) / BATCH_POINTS), min(64, (total or 0) // 1000))
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), batches // 16)
    place = keys.index(by) if by else None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*keys, "frame"], kind="stable")
        found: list[tuple] = []
        groups: dict = {}
        for key, part in rows.groupby(keys, sort=False, dropna=False):
            groups.setdefault(None if place is None else key[place], []).append((key, part["t"].to_numpy(), part["y"].to_numpy()))
        for value, traces in groups.items():
            wanted = chosen.get(value, [])
            fits = fit_together([(t, y) for _, t, y in traces], wanted, grid=grid, refine=refine, rounds=rounds) if wanted else []
            for (key, t, y), by_model in zip(traces, fits):
                for model in wanted:
                    if model.name in by_model:
                        fit = by_model[model.name]
                        found.append((*key, model.name, *fit, *_scores(t, y, model.name, model.basis, fit)))
        return pd.DataFrame(found, columns=[*keys, *(c.split()[0] for c in SCORED.split(", "))])

    key_types = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    batched = short.withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(batches))).repartition(tasks, "_batch")
    out = staged(batched.groupBy("_batch").applyInPandas(run, f"{key_types}, {SCORED}"))
    if longest is not None and longest > CHUNK_ROWS:
        out = out.unionByName(_fitted_in_parts(points.join(long, keys, "left_semi"), keys, chosen, by, grid, refine, rounds))
    return out


def _fitted_in_parts(
    points: DataFrame, keys: list[str], chosen: Mapping[str | None, Sequence[Model]], by: str | None, grid: int, refine: int, rounds: int
) -> DataFrame:
    """The same for long traces, whose parts are summed by different tasks."""
    out = None
    for value, models in chosen.items():
        rows = points if by is None else points.filter(F.col(by) == value)
        for basis, family in itertools.groupby(sorted(models, key=lambda m: m.basis), key=lambda m: m.basis):
            family = list(family)
            fits = fit_lines(rows, keys) if basis == "line" else fit_models(rows, keys, family, grid=grid, refine=refine, rounds=rounds).drop("grid_rss")
            scored = assess(rows, keys, fits)
            out = scored if out is None else out.unionByName(scored)
    return out


def starting_values(points: DataFrame, keys: Sequence[str], radius_pressure: float, c: float) -> DataFrame:
    """(keys, e, eta1, eta2): rough parameters of a creep trace, inside their bounds.

    e from the largest value, eta2 from the slope of the last third, eta1 from the time nearest 63 % of the largest value.
    A flow below eta1 is taken as twice eta1.
    """
    sized = with_summary(points, keys, F.count(F.lit(1)).alias("_n"))
    reached = smoothing.time_to_fraction(sized, keys, "t", "y").select(*keys, "peak", "t_fraction")
    late = F.col("frame") >= F.col("_n") - F.greatest(F.lit(5), F.floor(F.col("_n") / 3))
    slope = F.regr_slope(F.when(late, F.col("y")), F.when(late, F.col("t")))
    enough = (F.count(F.when(late, F.col("t"))) > 2) & (F.max(F.when(late, F.col("t"))) > F.min(F.when(late, F.col("t"))))
    slopes = sized.groupBy(*keys).agg(F.when(enough, slope).alias("_slope"))
    raw_e = radius_pressure / (c * F.col("peak"))
    eta1 = F.when(F.col("t_fraction") > 0, F.col("t_fraction") * c * raw_e / (3 * math.pi)).otherwise(5000.0)
    eta2 = F.when(F.col("_slope") > 0.01, radius_pressure / (3 * math.pi * F.col("_slope"))).otherwise(15000.0)

    def inside(value: Column, bounds: tuple[float, float]) -> Column:
        return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), value))

    out = reached.join(slopes, list(keys)).select(
        *keys, inside(raw_e, E_BOUNDS).alias("e"), inside(eta1, ETA_BOUNDS).alias("eta1"), inside(eta2, FLOW_BOUNDS).alias("eta2")
    )
    return out.withColumn("eta2", F.when(F.col("eta2") < F.col("eta1"), 2 * F.col("eta1")).otherwise(F.col("eta2")))


def near_bound(value: Column, lo: float, hi: float, *, margin: float = BOUND_MARGIN) -> Column:
    """Within ``margin`` of the log range of a bound, or not a number."""
    position = F.ln(value / lo) / math.log(hi / lo)
    return value.isNull() | F.isnan(value) | (value <= 0) | (position < margin) | (position > 1 - margin)


def viscoelastic_parameters(fits: DataFrame, radius_pressure: float, c: float) -> DataFrame:
    """Physical parameters of viscoelastic fits and the list of those sitting on a bound.

    e, eta1 and tau describe the solid element; eta2 the flow; e1 the series spring of Burgers.
    """
    model = F.col("model")
    out = (
        fits.withColumn("e", F.try_divide(F.lit(radius_pressure), c * F.col("c1")))
        .withColumn("eta1", F.col("s1") * c * F.col("e") / (3 * math.pi))
        .withColumn("tau", F.col("s1"))
        .withColumn(
            "eta2", F.when(model != "Kelvin-Voigt", F.try_divide(F.lit(radius_pressure), 3 * math.pi * F.col("c2")))
        )
        .withColumn("e1", F.when(model == "Burgers", F.try_divide(F.lit(radius_pressure), c * F.col("c3"))))
    )
    hits = [
        F.when(near_bound(F.col("e"), *E_BOUNDS), "e"),
        F.when(near_bound(F.col("eta1"), *ETA_BOUNDS), "eta1"),
        F.when((model != "Kelvin-Voigt") & near_bound(F.col("eta2"), *FLOW_BOUNDS), "eta2"),
        F.when((model == "Burgers") & near_bound(F.col("e1"), *E_BOUNDS), "e1"),
    ]
    return out.withColumn("bound_hit", F.array_compact(F.array(*hits)))


def select_model(
    fits: DataFrame, keys: Sequence[str], order: Sequence[str], *, score: str = "aicc", largest: bool = False
) -> DataFrame:
    """The winning fit per trace: least (or largest) score, ties to the model listed first."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    value = -F.col(score) if largest else F.col(score)
    rest = [c for c in fits.columns if c not in keys]
    return (
        fits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(value, place)).alias("_w")).select(*keys, "_w.*")
    )


def fit_viscoelastic(
    points: DataFrame, keys: Sequence[str], radius_pressure: float, c: float, *, check_flow: bool = True
) -> DataFrame:
    """All viscoelastic fits with parameters and scores; ``selected`` marks the winner per trace.

    Traces whose late flow does not stand out of the noise keep Kelvin-Voigt only,
    and a fit with a parameter on a bound cannot win.
    """
    scored = fitted(points, keys, viscoelastic_models(radius_pressure, c))
    return viscoelastic_winners(points, keys, scored, radius_pressure, c, check_flow=check_flow)


def viscoelastic_winners(
    points: DataFrame, keys: Sequence[str], scored: DataFrame, radius_pressure: float, c: float, *, check_flow: bool = True
) -> DataFrame:
    """Parameters of scored viscoelastic fits, without those that the flow rule leaves out, and the mark ``selected``."""
    scored = viscoelastic_parameters(scored, radius_pressure, c)
    if check_flow:
        sized = with_summary(points, keys, F.count(F.lit(1)).alias("n_rows"))
        flow = smoothing.side_slopes(sized, keys, "t", "y", n_rows="n_rows").select(*keys, "flow_ok")
        scored = scored.join(flow, list(keys)).filter(F.col("flow_ok") | (F.col("model") == "Kelvin-Voigt")).drop("flow_ok")
    able = scored.filter(F.size("bound_hit") == 0)
    won = select_model(able, keys, ["Kelvin-Voigt", "Jeffreys", "Burgers"]).select(*keys, F.col("model").alias("_won"))
    return scored.join(won, list(keys), "left").withColumn(
        "selected", F.coalesce(F.col("model") == F.col("_won"), F.lit(False))
    ).drop("_won")


def fit_line_or_power(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Line and power-law fits with scores; ``selected`` marks the winner, ties to the line."""
    return line_or_power_winners(keys, fitted(points, keys, [LINE, POWER_LAW]))


def line_or_power_winners(keys: Sequence[str], scored: DataFrame) -> DataFrame:
    won = select_model(scored, keys, ["Linear", "Power-Law"]).select(*keys, F.col("model").alias("_won"))
    return scored.join(won, list(keys)).withColumn("selected", F.col("model") == F.col("_won")).drop("_won")


def rise_points(df: DataFrame, keys: Sequence[str], t: str, y: str, *, min_points: int = MIN_POINTS, frame: str = "frame") -> DataFrame:
    """Rows after time 0 above the baseline of the rows up to it: (keys, frame, t, y, baseline).

    The baseline is the median of the rows up to time 0 when there are at least two,
    else the median of the first three rows, else the first row, else 0.
    """
    present = df.filter(F.col(y).isNotNull())
    early = quantiles(present.filter(F.col(t) <= 0), keys, y, {"_pre": 0.5}, count="_n_pre")
    head = summarise(
        present,
        keys,
        F.count(F.lit(1)).alias("_n"),
        F.percentile(F.when(F.col(frame) < 3, F.col(y)), F.lit(0.5)).alias("_three"),
        F.min_by(y, frame).alias("_one"),
        frame=frame,
    ).join(early, list(keys), "left")
    base = F.when(F.col("_n_pre") >= 2, F.col("_pre")).when(F.col("_n") >= 3, F.col("_three")).otherwise(F.col("_one"))
    corrected = (
        attach(present, head.withColumn("baseline", F.coalesce(base, F.lit(0.0))).select(*keys, "_last", "baseline"), keys, frame=frame)
        .withColumn("_y", F.col(y) - F.col("baseline"))
        .filter((F.col(t) > 0) & (F.col("_y") >= 0))
        .select(*keys, frame, F.col(t).alias("t"), F.col("_y").alias("y"), "baseline")
    )
    counted = renumber(corrected, keys, frame=frame, n_rows="_kept")
    return staged(counted.filter(F.col("_kept") >= min_points).select(*keys, frame, "t", "y", "baseline"))


def fit_rises(points: DataFrame, keys: Sequence[str], *, ratio_min: float = 3.0, share_min: float = 0.05, r2_floor: float = 0.85) -> DataFrame:
    """Mono- and bi-exponential rises with the selected one per trace.

    The bi-exponential counts only when its time constants differ by ``ratio_min``
    and its smaller amplitude is at least ``share_min`` of the total.
    """
    scored = fitted(points, keys, [MONO, BI])
    total = F.col("c1") + F.col("c2")
    real = (
        (F.col("s1") > 1e-9) & (total > 1e-9) & (F.col("s2") / F.col("s1") >= ratio_min)
        & (F.least("c1", "c2") / F.nullif(total, F.lit(0.0)) >= share_min)
    )
    able = scored.filter((F.col("model") == "Mono") | real)
    bi = F.col("model") == "Bi"
    both = scored.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col("aicc"))).alias(f"{m.lower()}_aicc") for m in ("Mono", "Bi")])
    return select_model(able, keys, ["Mono", "Bi"]).join(both, list(keys)).select(
        *keys,
        "mono_aicc",
        "bi_aicc",
        "model",
        F.when(bi, total).otherwise(F.col("c1")).alias("amplitude"),
        F.when(bi, (F.col("c1") * F.col("s1") + F.col("c2") * F.col("s2")) / F.nullif(total, F.lit(0.0)))
        .otherwise(F.col("s1"))
        .alias("tau"),
        "r2",
        "aicc",
        (F.col("r2") >= r2_floor).alias("r2_flag"),
        *[F.when(bi, F.col(c)).alias(n) for c, n in (("c1", "a1"), ("s1", "tau1"), ("c2", "a2"), ("s2", "tau2"))],
    )


def curves(fits: DataFrame, keys: Sequence[str], t_end: Column, *, points: int = 200) -> DataFrame:
    """Fitted values on an even grid from 0 to ``t_end``."""
    return (
        fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("t", F.col("i") * t_end / (points - 1))
        .select(*keys, "model", "i", "t", predict(F.col("model"), F.col("t")).alias("value"))
    )


def marker_slopes(
    df: DataFrame, keys: Sequence[str], rel_t: str, y: str, *, before: float = 5.0, after: float = 2.0, min_points: int = 3
) -> DataFrame:
    """Slopes just before and just after the marker, over positive values, where enough rows exist."""
    ok = F.col(y) > 0
    pre = ok & F.col(rel_t).between(-before, 0)
    post = ok & F.col(rel_t).between(0, after)

    def slope(inside: Column) -> Column:
        v, t = F.when(inside, F.col(y)), F.when(inside, F.col(rel_t))
        return F.when(F.count(v) >= min_points, F.regr_slope(v, t))

    return df.groupBy(*keys).agg(slope(pre).alias("pre_slope"), slope(post).alias("post_slope"))
