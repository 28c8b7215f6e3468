"""Model fits over the event traces, with the same grids spelled out in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparktraces.functions import physics
from sparktraces.operators import fit, resample
from sparktraces.plans.bindings import KEYS, MARKED, TRACES, marked, traces
from sparktraces.plans.queries.ordered import CLEAN, CLEANED, dense
from sparktraces.plans.registry import query, rounded, sql_round

PART = "PARTITION BY trace_id ORDER BY frame"
RP, C = 5000.0, 2.0


def points_of(spark, sf_dir):
    return fit.fit_points(dense(spark, sf_dir), KEYS, "t", "y", n_rows="n")


LONG_ENOUGH = f"""
, pk AS (SELECT trace_id, t, y, row_number() OVER ({PART}) - 1 AS frame, count(*) OVER (PARTITION BY trace_id) AS np, first(t) OVER ({PART}) AS t0 FROM clean WHERE inlier),
pt AS (SELECT trace_id, frame, t - t0 AS t, y FROM pk WHERE np >= 15)
"""
POINTS = CLEANED + LONG_ENOUGH

BASIS = {
    "rise": ("1 - exp(-t / s1)", "t", "1.0::DOUBLE"),
    "power": ("pow(t, s1)", "0.0::DOUBLE", "1.0::DOUBLE"),
    "two_rises": ("1 - exp(-t / s1)", "1 - exp(-t / s2)", "0.0::DOUBLE"),
}

# Lower and upper bounds of the three coefficients per model, as SQL over s1.
E_LO, E_HI = f"greatest(1.0, 3 * pi() / ({C} * s1))", f"least(100000.0, 3 * pi() / ({C} * s1) * 500000.0)"
RISE_BOX = (f"{RP}::DOUBLE / ({C} * {E_HI})", f"{RP}::DOUBLE / ({C} * {E_LO})")
FLOW_BOX = tuple(repr(RP / (3 * math.pi * v)) + "::DOUBLE" for v in (1e6, 500.0))
SPRING_BOX = tuple(repr(RP / (C * v)) + "::DOUBLE" for v in (1e5, 1.0))
ZERO, OPEN, ANY = ("0.0::DOUBLE", "0.0::DOUBLE"), ("0.0::DOUBLE", "1e300"), ("-1e300", "1e300")
BOXES = {
    "Kelvin-Voigt": (RISE_BOX, ZERO, ZERO),
    "Jeffreys": (RISE_BOX, FLOW_BOX, ZERO),
    "Burgers": (RISE_BOX, FLOW_BOX, SPRING_BOX),
    "Power-Law": (OPEN, ZERO, ANY),
    "Mono": (OPEN, ZERO, ZERO),
    "Exponential": (OPEN, ZERO, ANY),
    "Bi": (OPEN, OPEN, ZERO),
}


def spaced(lo, hi, n, i, log):
    part = f"({i}) / greatest({n} - 1, 1)::DOUBLE"
    return f"exp(ln({lo}) + (ln({hi}) - ln({lo})) * ({part}))" if log else f"{lo} + ({hi} - {lo}) * ({part})"


def det(m):
    return (
        f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
        f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    )


def round_sql(tag, source, specs, model, basis, log):
    """CTEs that pick the best grid point of one model: <tag>w(trace_id, i, s1, s2, c1..c3, lo1, ..., n2)."""
    g = BASIS[basis]
    box = BOXES[model.name]
    pats = ", ".join(str(p) for p in model.patterns())
    pair = "WHERE s1 < s2" if basis == "two_rises" else ""
    G = {(i, j): f"g{min(i, j) + 1}{max(i, j) + 1}" for i in range(3) for j in range(3)}
    m = [[f"(CASE WHEN p{i} > 0 OR p{j} > 0 THEN {1.0 if i == j else 0.0}::DOUBLE ELSE {G[i, j]} END)" for j in range(3)] for i in range(3)]
    rows = []
    for i in range(3):
        rest = f"b{i + 1}" + "".join(f" - (CASE WHEN p{j} > 0 THEN {G[i, j]} * v{j} ELSE 0 END)" for j in range(3) if j != i)
        rows.append(f"(CASE WHEN p{i} > 0 THEN v{i} ELSE {rest} END)")
    mm = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    cs = [det([[f"r{i}" if j == k else mm[i][j] for j in range(3)] for i in range(3)]) for k in range(3)]
    ok = " AND ".join(f"c{k + 1} >= lo_{k} - abs(lo_{k}) * 1e-9 AND c{k + 1} <= hi_{k} + abs(hi_{k}) * 1e-9" for k in range(3))
    rss = "yy" + "".join(f" - 2 * c{i + 1} * b{i + 1}" for i in range(3)) + "".join(
        f" + c{i + 1} * c{j + 1} * {G[i, j]}" for i in range(3) for j in range(3)
    )
    return f"""
, {tag}g AS (SELECT s.*, unnest(range(n1 * n2)) AS i FROM {specs} s),
{tag}s AS (SELECT *, {spaced('lo1', 'hi1', 'n1', 'i // n2', log)} AS s1, {spaced('lo2', 'hi2', 'n2', 'i % n2', log)} AS s2 FROM {tag}g),
{tag}b AS (SELECT s.trace_id, lo1, hi1, n1, lo2, hi2, n2, i, s1, s2, y, {g[0]} AS a, {g[1]} AS b, {g[2]} AS c
  FROM {source} p JOIN {tag}s s ON s.trace_id = p.trace_id {pair}),
{tag}n AS (SELECT trace_id, lo1, hi1, n1, lo2, hi2, n2, i, s1, s2, sum(y * y) AS yy, sum(y * a) AS b1, sum(y * b) AS b2, sum(y * c) AS b3,
  sum(a * a) AS g11, sum(a * b) AS g12, sum(a * c) AS g13, sum(b * b) AS g22, sum(b * c) AS g23, sum(c * c) AS g33 FROM {tag}b GROUP BY ALL),
{tag}x AS (SELECT *, {', '.join(f'{box[k][0]} AS lo_{k}, {box[k][1]} AS hi_{k}' for k in range(3))} FROM {tag}n),
{tag}p AS (SELECT x.*, p0, p1, p2, {', '.join(f'CASE p{k} WHEN 1 THEN lo_{k} WHEN 2 THEN hi_{k} ELSE 0 END AS v{k}' for k in range(3))}
  FROM {tag}x x, (VALUES {pats}) pat(p0, p1, p2)),
{tag}m AS (SELECT *, {', '.join(f'{m[i][j]} AS m{i}{j}' for i in range(3) for j in range(3))}, {', '.join(f'{rows[i]} AS r{i}' for i in range(3))} FROM {tag}p),
{tag}c AS (SELECT *, {', '.join(f'{cs[k]} / (CASE WHEN abs({det(mm)}) > 1e-12 * (m00 * m11 * m22) THEN {det(mm)} END) AS c{k + 1}' for k in range(3))} FROM {tag}m),
{tag}r AS (SELECT *, greatest({rss}, 0) AS rss FROM {tag}c WHERE {ok}),
{tag}o AS (SELECT *, row_number() OVER (PARTITION BY trace_id, i ORDER BY rss, c1, c2, c3) AS k FROM {tag}r),
{tag}z AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY floor(rss / yy * 1e9 + 0.5), i) AS kk FROM {tag}o WHERE k = 1),
{tag}w AS (SELECT * FROM {tag}z WHERE kk = 1)
"""


def fit_sql(tag, source, model, *, grid=96, refine=33, rounds=2):
    """CTEs ending in <tag>fit(trace_id, model, s1, s2, c1, c2, c3)."""
    basis = model.basis
    log, pair = basis != "power", basis == "two_rises"
    n1, nn = (24, 9) if pair else (grid, refine)
    lo, hi = ("0.0::DOUBLE", "2.0::DOUBLE") if not log else ("(max(t) - min(t)) / (count(*) - 1) / 3", "30 * (max(t) - min(t))")
    second = (lo, hi, n1) if pair else ("1.0::DOUBLE", "1.0::DOUBLE", 1)
    sql = f", {tag}0 AS (SELECT trace_id, {lo} AS lo1, {hi} AS hi1, {n1} AS n1, {second[0]} AS lo2, {second[1]} AS hi2, {second[2]} AS n2 FROM {source} GROUP BY trace_id)"
    for r in range(rounds + 1):
        sql += round_sql(f"{tag}{r}_", source, f"{tag}{r}", model, basis, log)
        if r < rounds:
            w = f"{tag}{r}_w"
            low = spaced("lo1", "hi1", "n1", "greatest(i // n2 - 1, 0)", log)
            high = spaced("lo1", "hi1", "n1", "least(i // n2 + 1, greatest(n1 - 1, 0))", log)
            low2 = spaced("lo2", "hi2", "n2", "greatest(i % n2 - 1, 0)", log)
            high2 = spaced("lo2", "hi2", "n2", "least(i % n2 + 1, greatest(n2 - 1, 0))", log)
            sql += f", {tag}{r + 1} AS (SELECT trace_id, {low} AS lo1, {high} AS hi1, {nn} AS n1, {low2} AS lo2, {high2} AS hi2, {nn if pair else 1} AS n2 FROM {w})"
    return sql + f", {tag}fit AS (SELECT trace_id, '{model.name}' AS model, s1, s2, c1, c2, c3 FROM {tag}{rounds}_w)"


def predict_sql(basis):
    g = BASIS[basis]
    return f"c1 * ({g[0]}) + c2 * ({g[1]}) + c3 * {g[2]}"


def assess_sql(tag, source, fits, basis):
    """CTE <tag>a: fits with n, rss, dw, r2, aicc, aic."""
    value = "c2 * t + c3" if basis == "line" else predict_sql(basis)
    ks = " ".join(f"WHEN '{m}' THEN {k}" for m, k in fit.N_PARAMS.items())
    return f"""
, {tag}e AS (SELECT f.*, p.frame, y, y - ({value}) AS e FROM {source} p JOIN {fits} f ON f.trace_id = p.trace_id),
{tag}d AS (SELECT *, e - lag(e) OVER (PARTITION BY trace_id, model ORDER BY frame) AS de FROM {tag}e),
{tag}q AS (SELECT trace_id, model, s1, s2, c1, c2, c3, count(*) AS n, sum(e * e) AS rss, sum(de * de) / sum(e * e) AS dw, var_pop(y) * count(*) AS sst,
  CASE model {ks} END AS k FROM {tag}d GROUP BY ALL),
{tag}f AS (SELECT *, 1 - rss / sst AS r2, n * ln(greatest(rss, 1e-12) / n) + 2 * k AS aic,
  greatest(k + 2.0::DOUBLE, least(n, n * (dw / 2) / (2 - dw / 2))) AS ne FROM {tag}q),
{tag}a AS (SELECT *, aic + 2.0::DOUBLE * k * (k + 1) / (ne - k - 1) AS aicc FROM {tag}f)
"""


SHOW = ["s1", "c1", "c2", "c3", "rss", "dw", "r2", "aicc"]


def show_sql(source, digits=3):
    return "SELECT trace_id, model, n, " + ", ".join(f"{sql_round(c, digits)} AS {c}" for c in SHOW) + f" FROM {source}"


def show(df, digits=3):
    return df.select("trace_id", "model", "n", *[rounded(c, digits).alias(c) for c in SHOW])


KV, JEFFREYS, BURGERS = fit.viscoelastic_models(RP, C)


def _fit_query(name, covers, model, source_sql, points, digits=3):
    """Registers the fit of one model over a point set."""

    @query(name, covers, source_sql + fit_sql("f", "pt", model) + assess_sql("f", "pt", "ffit", model.basis) + show_sql("fa", digits))
    def run(spark, sf_dir):
        rows = points(spark, sf_dir)
        return show(fit.fitted(rows, KEYS, [model]), digits)

    return run


_fit_query("kv_fit", "G5 G10 G16", KV, POINTS, points_of)
_fit_query("jeffreys_fit", "G6", JEFFREYS, POINTS, points_of)
_fit_query("burgers_fit", "G7", BURGERS, POINTS, points_of)
_fit_query("power_fit", "G3", fit.POWER_LAW, POINTS, points_of)


@query(
    "line_fit",
    "G1 G13 G14",
    POINTS
    + ", ffit AS (SELECT trace_id, 'Linear' AS model, 1.0::DOUBLE AS s1, 1.0::DOUBLE AS s2, 0.0::DOUBLE AS c1, regr_slope(y, t) AS c2, regr_intercept(y, t) AS c3 FROM pt GROUP BY trace_id)"
    + assess_sql("f", "pt", "ffit", "line")
    + show_sql("fa"),
)
def line_fit(spark, sf_dir):
    points = points_of(spark, sf_dir)
    return show(fit.fitted(points, KEYS, [fit.LINE]))


def line_power_sql(source):
    """CTEs la and pa with the scored fits, and win, where pick = 1 is the winner."""
    return (
        fit_sql("p", source, fit.POWER_LAW)
        + ", lfit AS (SELECT trace_id, 'Linear' AS model, 1.0::DOUBLE AS s1, 1.0::DOUBLE AS s2, 0.0::DOUBLE AS c1, regr_slope(y, t) AS c2, regr_intercept(y, t) AS c3 "
        + f"FROM {source} GROUP BY trace_id)"
        + assess_sql("l", source, "lfit", "line")
        + assess_sql("p", source, "pfit", "power")
        + """, bo AS (SELECT *, 0 AS o FROM la UNION ALL SELECT *, 1 AS o FROM pa),
win AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY aicc, o) AS pick FROM bo)
"""
    )


LINE_POWER = POINTS + line_power_sql("pt")


@query(
    "model_select",
    "G4 M19",
    LINE_POWER
    + f"SELECT trace_id, model, {sql_round('CASE model WHEN ' + chr(39) + 'Linear' + chr(39) + ' THEN c2 ELSE s1 END', 4)} AS winner_value, {sql_round('r2', 4)} AS winner_r2 FROM win WHERE pick = 1",
)
def model_select(spark, sf_dir):
    points = points_of(spark, sf_dir)
    won = fit.fit_line_or_power(points, KEYS).filter("selected")
    return won.select(
        "trace_id",
        "model",
        rounded(physics.winner_value(F.col("model"), F.col("c2"), F.col("s1")), 4).alias("winner_value"),
        rounded("r2", 4).alias("winner_r2"),
    )


@query(
    "prepost_slope",
    "G2 M20",
    MARKED
    + f""", al AS (SELECT trace_id, t - marker_t AS rel, y FROM mk WHERE condition <> 'ASP' AND marker_t IS NOT NULL),
s AS (SELECT trace_id, regr_slope(y, rel) FILTER (WHERE y > 0 AND rel BETWEEN -120 AND 0) AS pre, count(*) FILTER (WHERE y > 0 AND rel BETWEEN -120 AND 0) AS npre,
  regr_slope(y, rel) FILTER (WHERE y > 0 AND rel BETWEEN 0 AND 60) AS post, count(*) FILTER (WHERE y > 0 AND rel BETWEEN 0 AND 60) AS npost FROM al GROUP BY trace_id)
SELECT trace_id, {sql_round('CASE WHEN npre >= 3 THEN pre END')} AS pre_slope, {sql_round('CASE WHEN npost >= 3 THEN post END')} AS post_slope,
  CASE WHEN npost < 3 THEN NULL WHEN post > 0.02 THEN 'Extends' WHEN post < -0.02 THEN 'Retracts' ELSE 'Stable' END AS behaviour FROM s""",
)
def prepost_slope(spark, sf_dir):
    rows = marked(traces(spark, sf_dir)).filter((F.col("condition") != "ASP") & F.col("marker_t").isNotNull())
    out = fit.marker_slopes(
        rows.withColumn("rel", F.col("t") - F.col("marker_t")), KEYS, "rel", "y", before=120.0, after=60.0
    )
    return out.select(
        "trace_id",
        rounded("pre_slope").alias("pre_slope"),
        rounded("post_slope").alias("post_slope"),
        physics.behaviour_class(F.col("post_slope")).alias("behaviour"),
    )


#: From al(trace_id, frame, rel, y): the rows after the marker over the baseline.
RISING = """, ba AS (SELECT trace_id, CASE WHEN count(*) FILTER (WHERE rel <= 0) >= 2 THEN quantile_cont(y, 0.5) FILTER (WHERE rel <= 0)
  WHEN count(*) >= 3 THEN quantile_cont(y, 0.5) FILTER (WHERE frame < 3) ELSE arg_min(y, frame) END AS base FROM al GROUP BY trace_id),
rk AS (SELECT al.trace_id, rel AS t, y - base AS y, base, row_number() OVER (PARTITION BY al.trace_id ORDER BY frame) - 1 AS frame, count(*) OVER (PARTITION BY al.trace_id) AS np
  FROM al JOIN ba ON ba.trace_id = al.trace_id WHERE rel > 0 AND y - base >= 0),
pt AS (SELECT trace_id, frame, t, y, base FROM rk WHERE np >= 15)
"""
RISES = MARKED + ", al AS (SELECT trace_id, frame, t - marker_t AS rel, y FROM mk WHERE condition <> 'ASP' AND marker_t IS NOT NULL)" + RISING


def rise_sql(source):
    """CTEs ending in wn with the fits that may win, where pick = 1 is the winner."""
    return (
        fit_sql("one", source, fit.MONO) + assess_sql("one", source, "onefit", "rise")
        + fit_sql("two", source, fit.BI) + assess_sql("two", source, "twofit", "two_rises")
        + """, cand AS (SELECT *, 0 AS o FROM onea UNION ALL SELECT *, 1 FROM twoa WHERE s1 > 1e-9 AND c1 + c2 > 1e-9 AND s2 / s1 >= 3 AND least(c1, c2) / (c1 + c2) >= 0.05),
wn AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY aicc, o) AS pick FROM cand)
"""
    )


RISE_AMPLITUDE = "CASE o WHEN 1 THEN c1 + c2 ELSE c1 END"
RISE_TAU = "CASE o WHEN 1 THEN (c1 * s1 + c2 * s2) / (c1 + c2) ELSE s1 END"


def rises_of(spark, sf_dir):
    rows = marked(traces(spark, sf_dir)).filter((F.col("condition") != "ASP") & F.col("marker_t").isNotNull())
    return fit.rise_points(rows.withColumn("rel", F.col("t") - F.col("marker_t")), KEYS, "rel", "y")


_fit_query("mono_fit", "G8", fit.MONO, RISES, rises_of)
_fit_query("bi_fit", "G9", fit.BI, RISES, rises_of)


ENSEMBLE = (
    TRACES
    + f""", sg AS (SELECT *, lead(t) OVER ({PART}) AS t1, lead(y) OVER ({PART}) AS y1, lag(t) OVER ({PART}) AS pt FROM tr), gr AS (SELECT i, 0.0::DOUBLE + i * 8.0::DOUBLE AS g FROM (SELECT unnest(range(CAST(ceil(max(t) / 8.0) AS BIGINT) + 1)) AS i FROM tr)),
ip AS (SELECT arm, i, g, CASE WHEN g <= t OR t1 IS NULL THEN y ELSE y + (y1 - y) / (t1 - t) * (g - t) END AS value FROM sg JOIN gr ON (g >= t AND (g < t1 OR (t1 IS NULL AND g = t))) OR (pt IS NULL AND g < t) OR (t1 IS NULL AND g > t)),
pt AS (SELECT CASE arm WHEN '100us' THEN 0 ELSE 1 END AS trace_id, i AS frame, max(g) AS t, avg(value) AS y FROM ip GROUP BY arm, i)
"""
)


def ensemble_points(spark, sf_dir):
    """The held ensemble mean of each arm as a trace of its own."""
    rows = traces(spark, sf_dir)
    points = resample.interpolate(rows, KEYS, "t", "y", **resample.grid_to_end(rows, "t", start=0.0, step=8.0), hold=True)
    mean = resample.ensemble_mean(points, resample.bucket_sizes(rows, KEYS, ["arm"]), ["arm"])
    return fit.staged(
        mean.select(
            F.when(F.col("arm") == "100us", 0).otherwise(1).alias("trace_id"),
            F.col("i").alias("frame"), F.col("grid").alias("t"), F.col("mean").alias("y"),
        )
    )


#: Held ensemble means of the controls: trace 0 over all of them, traces 1 to 18 by trap position.
POINTS_OF_ENSEMBLES = (
    TRACES
    + f""", sg AS (SELECT *, lead(t) OVER ({PART}) AS t1, lead(y) OVER ({PART}) AS y1, lag(t) OVER ({PART}) AS pt FROM tr WHERE condition = 'ASP'),
gr AS (SELECT i, 0.0::DOUBLE + i * 8.0::DOUBLE AS g FROM (SELECT unnest(range(CAST(ceil(max(t) / 8.0) AS BIGINT) + 1)) AS i FROM sg)),
ip AS (SELECT trace_id % 18 + 1 AS trap, i, g, CASE WHEN g <= t OR t1 IS NULL THEN y ELSE y + (y1 - y) / (t1 - t) * (g - t) END AS value FROM sg JOIN gr ON (g >= t AND (g < t1 OR (t1 IS NULL AND g = t))) OR (pt IS NULL AND g < t) OR (t1 IS NULL AND g > t)),
pt AS (SELECT CAST(coalesce(trap, 0) AS BIGINT) AS trace_id, i AS frame, max(g) AS t, avg(value) AS y FROM ip GROUP BY GROUPING SETS ((i), (trap, i)))
"""
)


COMPARED = [KV, JEFFREYS, BURGERS, fit.POWER_LAW]


@query(
    "ensemble_model_comparison",
    "G19 G14",
    ENSEMBLE
    + "".join(fit_sql(f"m{i}", "pt", m) + assess_sql(f"m{i}", "pt", f"m{i}fit", m.basis) for i, m in enumerate(COMPARED))
    + ", lfit AS (SELECT trace_id, 'Linear' AS model, 1.0::DOUBLE AS s1, 1.0::DOUBLE AS s2, 0.0::DOUBLE AS c1, regr_slope(y, t) AS c2, regr_intercept(y, t) AS c3 FROM pt GROUP BY trace_id)"
    + assess_sql("l", "pt", "lfit", "line")
    + ", al AS (SELECT * FROM la" + "".join(f" UNION ALL SELECT * FROM m{i}a" for i in range(len(COMPARED))) + ")"
    + f" SELECT trace_id, model, {sql_round('r2', 4)} AS r2, {sql_round('aic', 3)} AS aic, row_number() OVER (PARTITION BY trace_id ORDER BY aic) = 1 AS best_aic FROM al",
)
def ensemble_model_comparison(spark, sf_dir):
    points = ensemble_points(spark, sf_dir)
    scored = fit.fitted(points, KEYS, [fit.LINE, *COMPARED])
    order = ["Linear", "Power-Law", "Kelvin-Voigt", "Jeffreys", "Burgers"]
    best = fit.select_model(scored, KEYS, order, score="aic").select("trace_id", F.col("model").alias("_b"))
    out = scored.join(best, "trace_id")
    return out.select(
        "trace_id", "model", rounded("r2", 4).alias("r2"), rounded("aic", 3).alias("aic"), (F.col("model") == F.col("_b")).alias("best_aic")
    )


@query(
    "line_curves",
    "G22",
    POINTS
    + f""", lf AS (SELECT trace_id, regr_slope(y, t) AS m, regr_intercept(y, t) AS b, max(t) AS e FROM pt GROUP BY trace_id)
SELECT trace_id, CAST(i AS BIGINT) AS i, {sql_round('i * e / 49')} AS t, {sql_round('m * (i * e / 49) + b')} AS value FROM lf, range(50) r(i)""",
)
def line_curves(spark, sf_dir):
    points = points_of(spark, sf_dir)
    ends = points.groupBy(*KEYS).agg(F.max("t").alias("e"))
    out = fit.curves(fit.fit_lines(points, KEYS).join(ends, KEYS), KEYS, F.col("e"), points=50)
    return out.select("trace_id", F.col("i").cast("long").alias("i"), rounded("t").alias("t"), rounded("value").alias("value"))


def _near(v, lo, hi):
    return f"({v} IS NULL OR {v} <= 0 OR ln({v} / {lo}) / ln({hi}::DOUBLE / {lo}) < 0.02 OR ln({v} / {lo}) / ln({hi}::DOUBLE / {lo}) > 0.98)"


CREEP = [KV, JEFFREYS, BURGERS]


def creep_sql(source):
    """CTEs ending in wn(trace_id, model, e, eta1, ..., pick), where pick = 1 is the winner."""
    return (
        "".join(fit_sql(f"m{i}", source, m) + assess_sql(f"m{i}", source, f"m{i}fit", "rise") for i, m in enumerate(CREEP))
        + f""", al AS (SELECT *, 0 AS o FROM m0a UNION ALL SELECT *, 1 FROM m1a UNION ALL SELECT *, 2 FROM m2a),
v1 AS (SELECT *, {RP}::DOUBLE / ({C} * c1) AS e, CASE WHEN o > 0 THEN {RP}::DOUBLE / (3 * pi() * c2) END AS eta2, CASE WHEN o = 2 THEN {RP}::DOUBLE / ({C} * c3) END AS e1 FROM al),
v2 AS (SELECT *, s1 * {C} * e / (3 * pi()) AS eta1 FROM v1),
cn AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n_rows FROM {source}),
sd AS (SELECT *, greatest(5, round_even(n_rows * 0.33::DOUBLE, 0)) AS side FROM cn),
fl AS (SELECT trace_id, abs(coalesce(regr_slope(y, t) FILTER (WHERE frame >= n_rows - side), 0)) * (max(t) - min(t)) > 1.5 * 0.3 AS flow_ok FROM sd GROUP BY trace_id),
ab AS (SELECT v2.* FROM v2 JOIN fl ON fl.trace_id = v2.trace_id WHERE (flow_ok OR o = 0) AND NOT {_near('e', '1.0', '100000.0')} AND NOT {_near('eta1', '1.0', '500000.0')}
  AND (o = 0 OR NOT {_near('eta2', '500.0', '1000000.0')}) AND (o < 2 OR NOT {_near('e1', '1.0', '100000.0')})),
wn AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY aicc, o) AS pick FROM ab)
"""
    )


@query(
    "viscoelastic_selection",
    "G11 G12 G5 G6 G7",
    POINTS
    + creep_sql("pt")
    + f"""SELECT trace_id, model, {', '.join(f'{sql_round(c, 3)} AS {c}' for c in ('e', 'eta1', 'eta2', 'e1', 'r2', 'aicc'))}, {sql_round('s1', 3)} AS tau FROM wn WHERE pick = 1""",
)
def viscoelastic_selection(spark, sf_dir):
    points = points_of(spark, sf_dir)
    out = fit.fit_viscoelastic(points, KEYS, RP, C).filter("selected")
    return out.select(
        "trace_id", "model", *[rounded(c, 3).alias(c) for c in ("e", "eta1", "eta2", "e1", "tau", "r2", "aicc")]
    )


@query(
    "rise_selection",
    "G8 G9 M23",
    RISES
    + rise_sql("pt")
    + f"""SELECT trace_id, model, {sql_round(RISE_AMPLITUDE, 3)} AS amplitude, {sql_round(RISE_TAU, 3)} AS tau, {sql_round('r2', 3)} AS r2, {sql_round('aicc', 3)} AS aicc,
  r2 >= 0.85 AS r2_flag FROM wn WHERE pick = 1""",
)
def rise_selection(spark, sf_dir):
    out = fit.fit_rises(rises_of(spark, sf_dir), KEYS)
    return out.select("trace_id", "model", *[rounded(c, 3).alias(c) for c in ("amplitude", "tau", "r2", "aicc")], "r2_flag")


SIX = [KV, JEFFREYS, BURGERS, fit.POWER_LAW, fit.EXPONENTIAL]


@query(
    "six_models",
    "G19 G20 G15",
    POINTS
    + ", ps AS (SELECT pt.* FROM pt WHERE trace_id % 3 = 0)"
    + "".join(fit_sql(f"m{i}", "ps", m) + assess_sql(f"m{i}", "ps", f"m{i}fit", m.basis) for i, m in enumerate(SIX))
    + ", lfit AS (SELECT trace_id, 'Linear' AS model, 1.0::DOUBLE AS s1, 1.0::DOUBLE AS s2, 0.0::DOUBLE AS c1, regr_slope(y, t) AS c2, regr_intercept(y, t) AS c3 FROM ps GROUP BY trace_id)"
    + assess_sql("l", "ps", "lfit", "line")
    + ", al AS (SELECT *, 0 AS o FROM la" + "".join(f" UNION ALL SELECT *, {i + 1} FROM m{i}a" for i in range(len(SIX))) + "),"
    + f" w AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY floor(r2 * 1e6 + 0.5) DESC, o) AS by_r2, row_number() OVER (PARTITION BY trace_id ORDER BY floor(aic * 1e3 + 0.5), o) AS by_aic FROM al)"
    + f" SELECT trace_id, 'control' AS phase, model, {sql_round('r2', 4)} AS r2, {sql_round('aic', 2)} AS aic, by_r2 = 1 AS best_r2, by_aic = 1 AS best_aic FROM w",
)
def six_models(spark, sf_dir):
    """Six models of each control, compared by R2 and by AIC; traces with a pulse are skipped."""
    points = points_of(spark, sf_dir).filter(F.col("trace_id") % 3 == 0)
    scored = fit.fitted(points, KEYS, [fit.LINE, *SIX])
    order = ["Linear", *(m.name for m in SIX)]
    # scores equal to the digits that two engines share are ties, which go to the model listed first
    shared = scored.withColumn("_r2", F.floor(F.col("r2") * 1e6 + 0.5)).withColumn("_aic", F.floor(F.col("aic") * 1e3 + 0.5))
    best = [
        fit.select_model(shared, KEYS, order, score=score, largest=score == "_r2").select("trace_id", F.col("model").alias(name))
        for score, name in (("_r2", "_by_r2"), ("_aic", "_by_aic"))
    ]
    out = scored.join(best[0], "trace_id").join(best[1], "trace_id")
    return out.select(
        "trace_id", F.lit("control").alias("phase"), "model", rounded("r2", 4).alias("r2"), rounded("aic", 2).alias("aic"),
        (F.col("model") == F.col("_by_r2")).alias("best_r2"), (F.col("model") == F.col("_by_aic")).alias("best_aic"),
    )


@query(
    "winner_curves",
    "G22 G4",
    LINE_POWER
    + f""", e AS (SELECT trace_id, max(t) AS e FROM pt GROUP BY trace_id)
SELECT w.trace_id, model, CAST(i AS BIGINT) AS i, {sql_round('i * e / 199', 5)} AS t,
  {sql_round("CASE model WHEN 'Linear' THEN c2 * (i * e / 199) + c3 ELSE c1 * pow(i * e / 199, s1) + c3 END", 3)} AS value FROM win w JOIN e ON e.trace_id = w.trace_id, range(200) r(i) WHERE pick = 1""",
)
def winner_curves(spark, sf_dir):
    """The curve of the winning model of each trace on 200 points."""
    points = points_of(spark, sf_dir)
    ends = points.groupBy(*KEYS).agg(F.max("t").alias("e"))
    won = fit.fit_line_or_power(points, KEYS).filter("selected")
    out = fit.curves(won.join(ends, KEYS), KEYS, F.col("e"), points=200)
    return out.select("trace_id", "model", F.col("i").cast("long").alias("i"), rounded("t", 5).alias("t"), rounded("value", 3).alias("value"))
