"""Channel physics and per-row measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.functions import measures as X
from sparktraces.functions import physics as P
from sparktraces.operators.sequence import with_summary
from sparktraces.plans.bindings import KEYS, TRACES, traces
from sparktraces.plans.registry import query, rounded, sql_round, table

FSTAR_SUM = " + ".join(f"tanh(pi() * {n} * x / 2) / {float(n**5)}::DOUBLE" for n in range(1, 22, 2))
FSTAR = f"""
WITH g AS (
  SELECT p_partkey, 5.0 + p_size * 0.1::DOUBLE AS w, 2.0 + p_retailprice / 500 AS h FROM part),
g2 AS (SELECT *, least(w, h) AS lo, greatest(w, h) AS hi, least(w, h) / greatest(w, h) AS x FROM g),
g3 AS (SELECT *, 1 / (pow(1 + 1 / x, 2) * (1 - 192 / (pow(pi(), 5) * x) * ({FSTAR_SUM}))) AS f FROM g2)
"""


def channels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.lit(5.0) + F.col("p_size") * F.lit(0.1)).alias("w"),
        (F.lit(2.0) + F.col("p_retailprice") / 500).alias("h"),
    )


@query(
    "fstar_reff",
    "M1 M2 M3",
    FSTAR
    + f"""SELECT p_partkey, {sql_round('f')} AS fstar, {sql_round('f * 0.95::DOUBLE')} AS fstar_low,
  {sql_round('f * 1.05::DOUBLE')} AS fstar_high,
  {sql_round('pow((2.0 / (3.0 * pi())) * hi * lo * lo * lo / (pow(1 + lo / hi, 2) * f), 0.25)')} AS r_eff FROM g3""",
)
def fstar_reff(spark, sf_dir):
    f = P.shape_factor(F.col("w"), F.col("h"))
    return channels(spark, sf_dir).select(
        "p_partkey",
        rounded(f).alias("fstar"),
        rounded(f * 0.95).alias("fstar_low"),
        rounded(f * 1.05).alias("fstar_high"),
        rounded(P.effective_radius(F.col("w"), F.col("h"))).alias("r_eff"),
    )


@query(
    "shear",
    "M4",
    FSTAR
    + f""", s AS (
  SELECT *, 1000.0 * (lo / 1e6) / (2 * 100.0 / 1e6) / (1 + lo / hi) AS stress FROM g3),
q AS (SELECT *, stress * (hi / 1e6) * pow(lo / 1e6, 2) / (6 * 0.001::DOUBLE * (1 + lo / hi) * f) AS flow FROM s)
SELECT p_partkey, {sql_round('stress')} AS wall_stress_pa,
  {sql_round('6 * flow / (hi / 1e6 * pow(lo / 1e6, 2)) * (1 + lo / hi) * f', 4)} AS wall_rate_per_s,
  {sql_round('flow * 1e9 * 60')} AS flow_ul_per_min, {sql_round('lo / hi')} AS aspect FROM q""",
)
def shear(spark, sf_dir):
    m = P.shear(F.col("w"), F.col("h"), F.lit(100.0), F.lit(1000.0), F.lit(0.001))
    return channels(spark, sf_dir).select(
        "p_partkey",
        rounded(m["wall_stress_pa"]).alias("wall_stress_pa"),
        rounded(m["wall_rate_per_s"], 4).alias("wall_rate_per_s"),
        rounded(m["flow_ul_per_min"]).alias("flow_ul_per_min"),
        rounded(m["aspect"]).alias("aspect"),
    )


@query(
    "forward_models",
    "M5",
    TRACES
    + f"""SELECT event_id, {sql_round('y * (1 - exp(-t / 40.0))')} AS kelvin_voigt,
  {sql_round('y * (1 - exp(-t / 40.0)) + 0.01::DOUBLE * t')} AS jeffreys,
  {sql_round('1.5 + (y * (1 - exp(-t / 40.0)) + 0.01::DOUBLE * t)')} AS burgers,
  {sql_round('y * pow(t, 0.25) + 2.0')} AS power_law, {sql_round('0.5 * t + y')} AS straight,
  {sql_round('y * (1 - exp(-t / 10.0)) + 3.0 * (1 - exp(-t / 200.0))')} AS two_rises FROM tr""",
)
def forward_models(spark, sf_dir):
    t, y = F.col("t"), F.col("y")
    lit = lambda v: F.lit(float(v))
    return traces(spark, sf_dir).select(
        "event_id",
        rounded(P.kelvin_voigt(t, y, lit(40))).alias("kelvin_voigt"),
        rounded(P.jeffreys(t, y, lit(40), lit(0.01))).alias("jeffreys"),
        rounded(P.burgers(t, lit(1.5), lit(0.01), y, lit(40))).alias("burgers"),
        rounded(P.power_law(t, y, lit(0.25), 2.0)).alias("power_law"),
        rounded(P.line(t, lit(0.5), y)).alias("straight"),
        rounded(P.two_rises(t, y, lit(10), lit(3), lit(200))).alias("two_rises"),
    )


REGION_ROWS = """
WITH r AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS body_count, CASE WHEN l_linenumber % 5 = 0 THEN 0.0::DOUBLE ELSE l_quantity - 10 END AS prot_count,
    l_extendedprice / 100 AS body_i, l_extendedprice / 80 AS prot_i, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount * 100 END AS len,
    l_tax * 100 AS f0, 0.629::DOUBLE AS sf FROM lineitem),
a AS (SELECT *, body_count * sf * sf AS body_a, prot_count * sf * sf AS prot_a FROM r),
v AS (SELECT *, (4 / (3 * sqrt(pi()))) * (greatest(body_a, 0) * sqrt(greatest(body_a, 0))) AS body_v,
    pi() * 3.0 * 3.0 * coalesce(len, 0) + (2.0::DOUBLE / 3) * pi() * 27.0 AS prot_v FROM a)
"""


def region_rows(spark, sf_dir):
    c = F.col
    sf = F.lit(P.SCALE_UM_PER_PX)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        c("l_quantity").alias("body_count"),
        F.when(c("l_linenumber") % 5 == 0, 0.0).otherwise(c("l_quantity") - 10).alias("prot_count"),
        (c("l_extendedprice") / 100).alias("body_i"),
        (c("l_extendedprice") / 80).alias("prot_i"),
        F.when(c("l_linenumber") != 4, c("l_discount") * 100).alias("len"),
        (c("l_tax") * 100).alias("f0"),
    )
    sized = rows.withColumn("body_a", P.pixel_sizes(c("body_count"), sf)["area_um2"]).withColumn(
        "prot_a", P.pixel_sizes(c("prot_count"), sf)["area_um2"]
    )
    return sized.withColumn("body_v", P.sphere_volume(c("body_a"))).withColumn(
        "prot_v", P.capped_cylinder_volume(c("len"), 3.0)
    )


@query(
    "region_volumes",
    "M6 M7 M8 M9",
    REGION_ROWS
    + f"""SELECT l_orderkey, l_linenumber, {sql_round('sqrt(body_count) * sf', 4)} AS linear_um,
  {sql_round('body_a * sqrt(body_a)', 4)} AS box_volume, {sql_round('body_v', 4)} AS body_v, {sql_round('prot_v', 4)} AS prot_v,
  {sql_round('body_v + prot_v', 4)} AS total_v,
  {sql_round('CASE WHEN body_a + prot_a > 0 THEN (body_i * body_a + prot_i * prot_a) / (body_a + prot_a) ELSE 0 END', 4)} AS total_i FROM v""",
)
def region_volumes(spark, sf_dir):
    c = F.col
    px = P.pixel_sizes(c("body_count"), F.lit(P.SCALE_UM_PER_PX))
    return region_rows(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        rounded(px["linear_um"], 4).alias("linear_um"),
        rounded(px["volume_um3"], 4).alias("box_volume"),
        rounded("body_v", 4).alias("body_v"),
        rounded("prot_v", 4).alias("prot_v"),
        rounded(c("body_v") + c("prot_v"), 4).alias("total_v"),
        rounded(X.weighted_intensity(c("body_i"), c("body_a"), c("prot_i"), c("prot_a")), 4).alias("total_i"),
    )


@query(
    "region_normalised",
    "M10 M11 M12 M14 M15",
    REGION_ROWS
    + f""", w AS (SELECT *, CASE WHEN body_count > 0 THEN body_a ELSE 0 END AS wb, CASE WHEN prot_count > 0 THEN prot_a ELSE 0 END AS wp FROM v)
SELECT l_orderkey, l_linenumber,
  {sql_round('CASE WHEN body_count > 0 AND body_v > 0 THEN (body_i - f0) / body_v END')} AS body_volnorm,
  {sql_round('CASE WHEN prot_count > 0 AND prot_v > 0 THEN (prot_i - f0) / prot_v END')} AS prot_volnorm,
  {sql_round('CASE WHEN wb + wp > 0 THEN ((body_i - f0) * wb + (prot_i - f0) * wp) / (wb + wp) / (body_v + prot_v) END')} AS total_volnorm,
  {sql_round('CASE WHEN f0 > 1e-6::DOUBLE THEN (body_i - f0) / f0 ELSE 0 END', 4)} AS rel_change,
  {sql_round('body_i / greatest(f0, 1e-6::DOUBLE)', 2)} AS over_f0,
  {sql_round('CASE WHEN body_i > 0 THEN prot_i / body_i ELSE 0 END')} AS prot_body_ratio,
  {sql_round('body_i * body_a', 4)} AS integrated_density,
  {sql_round('CASE WHEN body_v > 0 THEN body_i / body_v ELSE 0 END')} AS volume_corrected FROM w""",
)
def region_normalised(spark, sf_dir):
    c = F.col
    body_rise, prot_rise = c("body_i") - c("f0"), c("prot_i") - c("f0")
    return region_rows(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        rounded(X.volume_normalised(c("body_i"), c("f0"), c("body_v"), c("body_count"))).alias("body_volnorm"),
        rounded(X.volume_normalised(c("prot_i"), c("f0"), c("prot_v"), c("prot_count"))).alias("prot_volnorm"),
        rounded(
            X.total_volume_normalised(
                body_rise, c("body_a"), c("body_count"), prot_rise, c("prot_a"), c("prot_count"), c("body_v") + c("prot_v")
            )
        ).alias("total_volnorm"),
        rounded(X.relative_change(body_rise, c("f0")), 4).alias("rel_change"),
        rounded(X.over_baseline(c("body_i"), c("f0")), 2).alias("over_f0"),
        rounded(X.guarded_ratio(c("prot_i"), c("body_i"))).alias("prot_body_ratio"),
        rounded(c("body_i") * c("body_a"), 4).alias("integrated_density"),
        rounded(X.guarded_ratio(c("body_i"), c("body_v"))).alias("volume_corrected"),
    )


@query(
    "minmax_scaled",
    "M13",
    TRACES
    + f"""SELECT event_id, {sql_round('coalesce((y - lo) / nullif(hi - lo, 0), 0)')} AS scaled,
  {sql_round('coalesce(y / 10 / nullif(hi - lo, 0), 0)')} AS spread_scaled
FROM (SELECT *, min(y) OVER (PARTITION BY trace_id) AS lo, max(y) OVER (PARTITION BY trace_id) AS hi FROM tr)""",
)
def minmax_scaled(spark, sf_dir):
    rows = with_summary(traces(spark, sf_dir), KEYS, F.min("y").alias("lo"), F.max("y").alias("hi"))
    return rows.select(
        "event_id",
        rounded(X.minmax(F.col("y"), F.col("lo"), F.col("hi"))).alias("scaled"),
        rounded(X.range_scaled(F.col("y") / 10, F.col("lo"), F.col("hi"))).alias("spread_scaled"),
    )


@query(
    "class_rules",
    "M16 M20 M21 M22 M24 M25 M26",
    f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS tx, l_extendedprice AS p FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN q / 25 < 0.9 THEN 'interior' WHEN q / 25 <= 1.1 THEN 'uniform' WHEN d * 5 <= 0.4 THEN 'cortex' ELSE 'patches' END AS structure,
  CASE WHEN d - 0.05 > 0.02 THEN 'Extends' WHEN d - 0.05 < -0.02 THEN 'Retracts' ELSE 'Stable' END AS behaviour,
  CASE WHEN tx * 20 - d * 10 > 0.5 THEN 'grows' WHEN tx * 20 - d * 10 < -0.5 THEN 'retracts' ELSE 'steady' END AS growth,
  q * 20 BETWEEN 10.0 AND 10000.0 AND p / 10 BETWEEN 10.0 AND 10000.0 AND p / 5 BETWEEN 10.0 AND 10000.0 AS valid,
  CAST((CASE WHEN NOT q * 20 BETWEEN 100 AND 1000 THEN 1 ELSE 0 END) + (CASE WHEN NOT p / 10 BETWEEN 100 AND 1000 THEN 1 ELSE 0 END)
    + (CASE WHEN NOT p / 5 BETWEEN 100 AND 1000 THEN 1 ELSE 0 END)
    + (CASE WHEN NOT (3 * pi() * (p / 10) / (q * 20) > 0.1 AND 3 * pi() * (p / 10) / (q * 20) < 100) THEN 1 ELSE 0 END)
    + (CASE WHEN NOT (p / 5 / (p / 10) > 1.5 AND p / 5 / (p / 10) < 50) THEN 1 ELSE 0 END) AS BIGINT) AS n_warnings,
  {sql_round('4 * pi() * q / nullif(p / 1000 * (p / 1000), 0)')} AS circularity,
  greatest(d - 0.05, 1e-3::DOUBLE) AS floored,
  CASE WHEN d * 10 < 0.147 THEN 'negligible' WHEN d * 10 < 0.33 THEN 'small' WHEN d * 10 < 0.474 THEN 'medium' ELSE 'large' END AS effect,
  CASE WHEN tx < 0.001 THEN '***' WHEN tx < 0.01 THEN '**' WHEN tx < 0.05 THEN '*' ELSE 'ns' END AS stars
FROM x
""",
)
def class_rules(spark, sf_dir):
    q, d, tx, p = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
    ranges = {"e": (100.0, 1000.0), "eta1": (100.0, 1000.0), "eta2": (100.0, 1000.0)}
    check = P.plausibility(q * 20, p / 10, p / 5, ranges)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        P.structure_class(q / 25, d * 5).alias("structure"),
        P.behaviour_class(d - 0.05).alias("behaviour"),
        P.growth_class(d * 10, tx * 20).alias("growth"),
        check["valid"].alias("valid"),
        F.size(check["warnings"]).cast("long").alias("n_warnings"),
        rounded(P.circularity(q, p / 1000)).alias("circularity"),
        P.log_floor(d - 0.05).alias("floored"),
        P.effect_class(d * 10).alias("effect"),
        P.stars(tx).alias("stars"),
    )


C = 2.0
RP = 5000.0


@query(
    "model_parameters",
    "M17 M18 M23",
    f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, 1 + l_discount * 100 AS tau, l_extendedprice / 1000 + 1 AS m,
  list_extract(['Kelvin-Voigt', 'Jeffreys', 'Burgers'], CAST(l_linenumber % 3 + 1 AS INT)) AS model, l_tax * 100 + 2 AS tau2 FROM lineitem),
e AS (SELECT *, {RP}::DOUBLE / ({C}::DOUBLE * a) AS e FROM x),
v AS (SELECT *, tau * {C}::DOUBLE * e / (3 * pi()) AS eta, {RP}::DOUBLE / (3 * pi() * m) AS eta_flow FROM e)
SELECT l_orderkey, l_linenumber, {sql_round('e', 4)} AS e, {sql_round('eta', 4)} AS eta, {sql_round('eta_flow', 4)} AS eta_flow,
  {sql_round("3 * pi() * (CASE model WHEN 'Kelvin-Voigt' THEN eta WHEN 'Jeffreys' THEN eta * 2 ELSE eta * 3 END) / (2.0::DOUBLE * (CASE model WHEN 'Burgers' THEN e * 2 ELSE e END))", 4)} AS tau_s,
  {sql_round('CASE WHEN tau > tau2 THEN m ELSE a END', 4)} AS fast_a, {sql_round('least(tau, tau2)', 4)} AS fast_tau,
  {sql_round('(a * tau + m * tau2) / (a + m)', 4)} AS mean_tau FROM v
""",
)
def model_parameters(spark, sf_dir):
    c = F.col
    names = F.array(*[F.lit(x) for x in ("Kelvin-Voigt", "Jeffreys", "Burgers")])
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        c("l_quantity").alias("a"),
        (1 + c("l_discount") * 100).alias("tau"),
        (c("l_extendedprice") / 1000 + 1).alias("m"),
        F.element_at(names, (c("l_linenumber") % 3 + 1).cast("int")).alias("model"),
        (c("l_tax") * 100 + 2).alias("tau2"),
    )
    rows = rows.withColumn("e", P.rise_to_modulus(c("a"), F.lit(RP), C))
    rows = rows.withColumn("eta", P.tau_to_viscosity(c("tau"), c("e"), C)).withColumn(
        "eta_flow", P.slope_to_viscosity(c("m"), F.lit(RP))
    )
    feature = P.rename_burgers(c("e"), c("eta"), c("e") * 2, c("eta") * 3)
    params = {
        "eta": c("eta"), "e": c("e"), "eta1": c("eta") * 2,
        "burgers_eta2": feature["eta1"], "burgers_e2": feature["e"],
    }
    pair = P.ordered_rises(c("a"), c("tau"), c("m"), c("tau2"))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        rounded("e", 4).alias("e"),
        rounded("eta", 4).alias("eta"),
        rounded("eta_flow", 4).alias("eta_flow"),
        rounded(P.relaxation_time(c("model"), params, C), 4).alias("tau_s"),
        rounded(pair["a1"], 4).alias("fast_a"),
        rounded(pair["tau1"], 4).alias("fast_tau"),
        rounded(pair["mean_tau"], 4).alias("mean_tau"),
    )
