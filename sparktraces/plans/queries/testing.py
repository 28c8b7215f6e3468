"""Rank tests, correlations and test tables over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.functions.physics import stars
from sparktraces.operators import cohorts, ranks, stats
from sparktraces.operators.quantiles import quantiles
from sparktraces.plans.registry import query, rounded, sql_round, table


def rank_sql(source: str, by: str, value: str) -> str:
    part = f"PARTITION BY {by} ORDER BY {value}" if by else f"ORDER BY {value}"
    same = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return f"(rank() OVER ({part}) + (count(*) OVER ({same}) - 1) / 2.0::DOUBLE)"


def gamma_tail_sql(a: str, x: str) -> str:
    """SQL for the upper tail of the gamma distribution as one minus a series of positive terms; 0 far out."""
    terms = f"list_sum([exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1)) FOR i IN range(0, 900)])"
    return f"(CASE WHEN {x} <= 0 THEN 1.0::DOUBLE WHEN {x} > 200 + 2 * ({a}) THEN 0.0::DOUBLE ELSE greatest(0.0, 1 - {terms}) END)"


STARS_SQL = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p IS NOT NULL THEN 'ns' END"


def normal_p_sql(z: str) -> str:
    """SQL for the two-sided p of a normal statistic."""
    return gamma_tail_sql("0.5::DOUBLE", f"({z} * {z} / 2)")


def student_p_sql(t: str, df: str) -> str:
    """SQL for the two-sided p of Student's t: one minus the incomplete beta function as a series of positive terms."""
    y = f"({t} * {t} / ({df} + {t} * {t}))"
    front = f"exp(0.5 * ln({y}) + {df} / 2 * ln(1 - {y}) + lgamma(({df} + 1) / 2) - lgamma({df} / 2) - lgamma(0.5::DOUBLE) + ln(2.0::DOUBLE))"
    terms = (
        f"list_sum([exp(lgamma(({df} + 1) / 2 + i) - lgamma(({df} + 1) / 2) + lgamma(1.5::DOUBLE) - lgamma(1.5::DOUBLE + i) + i * ln({y})) FOR i IN range(0, 2000)])"
    )
    return f"(CASE WHEN {t} = 0 THEN 1.0::DOUBLE WHEN abs({t}) > 9 AND {df} > 60 THEN 0.0::DOUBLE ELSE greatest(0.0, 1 - {front} * {terms}) END)"


@query(
    "average_ranks",
    "W28",
    f"SELECT l_orderkey, l_linenumber, {rank_sql('lineitem', 'l_returnflag', 'l_quantity')} AS rank FROM lineitem",
)
def average_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return ranks.average_ranks(rows, ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "rank")


@query(
    "spearman",
    "T1 T11",
    f"""
WITH r AS (SELECT l_linestatus, {rank_sql('', 'l_linestatus', 'l_quantity')} AS rx, {rank_sql('', 'l_linestatus', 'l_extendedprice')} AS ry FROM lineitem),
r2 AS (SELECT l_linestatus, {rank_sql('', 'l_linestatus', 'l_discount')} AS rx, {rank_sql('', 'l_linestatus', 'l_tax')} AS ry FROM lineitem),
c AS (SELECT 'price' AS pair, l_linestatus, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY l_linestatus
  UNION ALL SELECT 'tax', l_linestatus, count(*), corr(rx, ry) FROM r2 GROUP BY l_linestatus),
t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t_stat, (n - 2)::DOUBLE AS f FROM c)
SELECT pair, l_linestatus, n, {sql_round('rho')} AS rho, {sql_round('t_stat', 3)} AS t_stat, {sql_round(student_p_sql('t_stat', 'f'), 5)} AS p FROM t
""",
)
def spearman(spark, sf_dir):
    pairs = [("price", "l_quantity", "l_extendedprice", None), ("tax", "l_discount", "l_tax", None)]
    out = stats.with_spearman_p(stats.correlation_sweep(table(spark, sf_dir, "lineitem"), pairs, ["l_linestatus"]))
    return out.select(
        F.col("spec").alias("pair"), "l_linestatus", "n", rounded("rho").alias("rho"), rounded("t_stat", 3).alias("t_stat"),
        rounded("p", 5).alias("p"),
    )


MATRIX_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def matrix_sql() -> str:
    parts = []
    for i, a in enumerate(MATRIX_COLUMNS):
        for b in MATRIX_COLUMNS[i:]:
            parts.append(
                f"SELECT l_returnflag, '{a}' AS x_name, '{b}' AS y_name, count(*) AS n, {sql_round(f'corr(r_{a}, r_{b})')} AS rho FROM rk GROUP BY l_returnflag"
            )
    ranked = ", ".join(f"{rank_sql('', 'l_returnflag', c)} AS r_{c}" for c in MATRIX_COLUMNS)
    return f"WITH rk AS (SELECT l_returnflag, {ranked} FROM lineitem) " + " UNION ALL ".join(parts)


@query("spearman_matrix", "A34 F16", matrix_sql())
def spearman_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    columns = cohorts.varying_columns(rows, MATRIX_COLUMNS)
    out = stats.spearman_matrix(rows, columns, ["l_returnflag"])
    return out.select("l_returnflag", "x_name", "y_name", "n", rounded("rho").alias("rho"))


def mw_sql(source: str, by: str, arm: str, value: str, first: str, second: str, extra: str = "") -> str:
    """CTEs ending in mw(by, n1, n2, u, z, cliffs_delta)."""
    return f"""
{extra} mr AS (SELECT {by} AS panel, {arm} AS arm, {value} AS v FROM {source} WHERE {arm} IN ('{first}', '{second}') AND {value} IS NOT NULL),
mk2 AS (SELECT panel, arm, v, {rank_sql('', 'panel', 'v')} AS r FROM mr),
mt AS (SELECT panel, sum(pow(c, 3) - c) AS tie FROM (SELECT panel, count(*)::DOUBLE AS c FROM mr GROUP BY panel, v) GROUP BY panel),
ms2 AS (SELECT panel, count(*) FILTER (WHERE arm = '{first}') AS n1, count(*) FILTER (WHERE arm = '{second}') AS n2, sum(r) FILTER (WHERE arm = '{first}') AS r1 FROM mk2 GROUP BY panel),
mu AS (SELECT s.*, tie, r1 - n1 * (n1 + 1) / 2 AS u, n1::DOUBLE * n2 AS nn, (n1 + n2)::DOUBLE AS nt FROM ms2 s JOIN mt ON mt.panel = s.panel),
mw AS (SELECT panel, n1, n2, u, greatest(abs(u - nn / 2) - 0.5, 0) * sign(u - nn / 2) / sqrt(nn / 12 * (nt + 1 - tie / (nt * (nt - 1)))) AS z, 2 * u / nn - 1 AS cliffs_delta FROM mu)
"""


@query(
    "mannwhitney_cliff",
    "T2 T3 J12",
    mw_sql("lineitem", "l_linenumber", "l_returnflag", "l_extendedprice", "A", "R", "WITH")
    + f", mp AS (SELECT *, {sql_round(normal_p_sql('z'))} AS p FROM mw) "
    f"SELECT panel AS l_linenumber, n1, n2, {sql_round('u', 1)} AS u, {sql_round('z')} AS z, p, {STARS_SQL} AS stars, {sql_round('cliffs_delta')} AS cliffs_delta FROM mp",
)
def mannwhitney_cliff(spark, sf_dir):
    out = ranks.two_sample_ranks(
        table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_returnflag", "l_extendedprice", "A", "R"
    )
    out = out.withColumn("p", rounded(stats.normal_p("z")))
    return out.select(
        "l_linenumber", "n1", "n2", rounded("u", 1).alias("u"), rounded("z").alias("z"), "p", stars(F.col("p")).alias("stars"),
        rounded("cliffs_delta").alias("cliffs_delta"),
    )


@query(
    "replicate_tests",
    "T4 T14",
    "WITH rm AS (SELECT c_mktsegment, avg(c_acctbal) AS v FROM customer GROUP BY c_mktsegment, c_nationkey), bp AS (SELECT 'BUILDING vs MACHINERY' AS pair, CASE c_mktsegment WHEN 'BUILDING' THEN 'first' ELSE 'second' END AS side, v FROM rm WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') "
    "UNION ALL SELECT 'BUILDING vs FURNITURE', CASE c_mktsegment WHEN 'BUILDING' THEN 'first' ELSE 'second' END, v FROM rm WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')), "
    + mw_sql("bp", "pair", "side", "v", "first", "second")
    + f"SELECT panel AS pair, n1, n2, {sql_round('u', 1)} AS u, {sql_round('z')} AS z, {sql_round(normal_p_sql('z'))} AS p, {sql_round('cliffs_delta')} AS cliffs_delta FROM mw",
)
def replicate_tests(spark, sf_dir):
    out = stats.replicate_tests(
        table(spark, sf_dir, "customer"), "c_mktsegment", ["c_nationkey"], "c_acctbal",
        [("BUILDING", "MACHINERY"), ("BUILDING", "FURNITURE")],
    )
    return out.select(
        "pair", "n1", "n2", rounded("u", 1).alias("u"), rounded("z").alias("z"), rounded(stats.normal_p("z")).alias("p"),
        rounded("cliffs_delta").alias("cliffs_delta"),
    )


@query(
    "wilcoxon",
    "T5",
    f"""
WITH d AS (SELECT l_returnflag AS g, l_tax * 100 - l_discount * 100 AS d FROM lineitem WHERE l_tax * 100 - l_discount * 100 <> 0),
r AS (SELECT g, d, {rank_sql('', 'g', 'abs(d)')} AS r FROM d),
t AS (SELECT g, sum(pow(c, 3) - c) AS tie FROM (SELECT g, count(*)::DOUBLE AS c FROM d GROUP BY g, abs(d)) GROUP BY g),
s AS (SELECT g, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus FROM r GROUP BY g)
, z AS (SELECT s.*, (least(w_plus, w_minus) - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM s JOIN t ON t.g = s.g)
SELECT g AS l_returnflag, n, {sql_round('w_plus', 1)} AS w_plus, {sql_round('w_minus', 1)} AS w_minus, {sql_round('z')} AS z, {sql_round(normal_p_sql('z'))} AS p,
  {sql_round('(SELECT quantile_cont(l_tax * 100 - l_discount * 100, 0.5) FROM lineitem x WHERE x.l_returnflag = z.g)')} AS median_difference FROM z
""",
)
def wilcoxon(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_discount") * 100).alias("a"), (F.col("l_tax") * 100).alias("b")
    )
    out = ranks.wilcoxon_signed_rank(rows, ["l_returnflag"], "a", "b")
    return out.select(
        "l_returnflag", "n", rounded("w_plus", 1).alias("w_plus"), rounded("w_minus", 1).alias("w_minus"), rounded("z").alias("z"),
        rounded(stats.normal_p("z")).alias("p"), rounded("median_difference").alias("median_difference"),
    )


@query(
    "kruskal",
    "T6",
    f"""
WITH r AS (SELECT o_orderpriority AS lv, {rank_sql('', '', 'o_totalprice')} AS r FROM orders),
t AS (SELECT sum(pow(c, 3) - c) AS tie FROM (SELECT count(*)::DOUBLE AS c FROM orders GROUP BY o_totalprice)),
g AS (SELECT lv, count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY lv),
a AS (SELECT count(*) AS levels, sum(n) AS n, sum(s * s / n) AS q FROM g)
, h AS (SELECT levels, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h FROM a, t),
p AS (SELECT *, {sql_round(gamma_tail_sql('((levels - 1) / 2.0::DOUBLE)', '(h / 2)'))} AS p FROM h)
SELECT 'all' AS panel, levels, CAST(n AS BIGINT) AS n, {sql_round('h', 5)} AS h, p, CASE WHEN p < 0.05 THEN 'differ' ELSE 'alike' END AS verdict FROM p
""",
)
def kruskal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("panel", F.lit("all"))
    out = ranks.kruskal_wallis(rows, ["panel"], "o_orderpriority", "o_totalprice")
    out = out.withColumn("p", rounded(stats.chi2_p("h", (F.col("levels") - 1).cast("double"))))
    verdict = F.when(F.col("p") < 0.05, "differ").when(F.col("p").isNotNull(), "alike")
    return out.select("panel", "levels", "n", rounded("h", 5).alias("h"), "p", verdict.alias("verdict"))


@query(
    "trend_band",
    "T7",
    f"""
WITH g AS (SELECT l_linenumber AS k, count(*) AS n, regr_slope(log10(l_extendedprice), l_quantity) AS m, regr_intercept(log10(l_extendedprice), l_quantity) AS b,
  regr_r2(log10(l_extendedprice), l_quantity) AS r2, var_pop(log10(l_extendedprice)) AS v FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1),
h AS (SELECT *, 1.96 * sqrt(v * (1 - r2)) / sqrt(n) AS w FROM g)
SELECT k AS l_linenumber, n, {sql_round('m')} AS slope, {sql_round('b')} AS intercept, {sql_round('r2')} AS r2, {sql_round('w')} AS half_width,
  {sql_round('pow(10, m * 25 + b)', 3)} AS fit, {sql_round('pow(10, m * 25 + b - w)', 3)} AS low, {sql_round('pow(10, m * 25 + b + w)', 3)} AS high FROM h
""",
)
def trend_band(spark, sf_dir):
    trend = stats.fitted_trend(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_quantity", "l_extendedprice", log_y=True)
    out = stats.trend_band(trend, F.lit(25.0), log_y=True)
    return out.select(
        "l_linenumber", "n", *[rounded(c).alias(c) for c in ("slope", "intercept", "r2", "half_width")],
        *[rounded(c, 3).alias(c) for c in ("fit", "low", "high")],
    )


# lineitem as a fit table: the price per hundred is an amplitude, the tax an R2 and the discount a time constant.
FITS = """
WITH ft AS (SELECT l_orderkey, l_linenumber, l_linestatus AS region, CASE l_returnflag WHEN 'A' THEN '100us' WHEN 'R' THEN '5ms' ELSE 'ASP' END AS arm,
  l_extendedprice / 100 AS a, l_discount * 300000 AS tau, l_tax * 12.5 AS r2, l_extendedprice / 100 * (1 - exp(-9000.0::DOUBLE / nullif(l_discount * 300000, 0))) AS i_ref FROM lineitem),
gt AS (SELECT *, arm <> 'ASP' AS candidate, arm <> 'ASP' AND r2 >= 0.5 AS gate_pass, arm <> 'ASP' AND r2 >= 0.5 AND tau > 20000 AND a >= 100 AS runaway FROM ft),
gd AS (SELECT *, gate_pass AND NOT runaway AS retained FROM gt)
"""


def fit_rows(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        c("l_linestatus").alias("region"),
        F.when(c("l_returnflag") == "A", "100us").when(c("l_returnflag") == "R", "5ms").otherwise("ASP").alias("arm"),
        (c("l_extendedprice") / 100).alias("a"),
        (c("l_discount") * 300000).alias("tau"),
        (c("l_tax") * 12.5).alias("r2"),
        # the fitted value at a reference time
        (c("l_extendedprice") / 100 * (1 - F.exp(F.try_divide(F.lit(-9000.0), c("l_discount") * 300000)))).alias("i_ref"),
    )
    return cohorts.gated(
        rows, member=c("arm") != "ASP", passed=c("r2") >= 0.5, runaway=cohorts.is_runaway(c("tau"), c("a"))
    )


@query(
    "gate_counts",
    "F8 F9 A35",
    FITS
    + "SELECT region, arm, count(*) FILTER (WHERE candidate) AS candidates, count(*) FILTER (WHERE gate_pass) AS gate_pass, count(*) FILTER (WHERE runaway) AS runaway, count(*) FILTER (WHERE retained) AS retained FROM gd GROUP BY ALL",
)
def gate_counts(spark, sf_dir):
    return cohorts.gate_counts(fit_rows(spark, sf_dir), ["region", "arm"])


@query(
    "cohort_partition",
    "F10 F13",
    FITS
    + "SELECT region, CASE WHEN retained THEN 'analysed' WHEN runaway THEN 'runaway' ELSE 'r2_failed' END AS subset, count(*) AS n FROM gd WHERE candidate GROUP BY ALL",
)
def cohort_partition(spark, sf_dir):
    rows = fit_rows(spark, sf_dir).filter("candidate")
    return rows.groupBy("region", "subset").agg(F.count(F.lit(1)).alias("n"))


def kinetics_sql() -> str:
    names = ["a", "tau", "i_ref"]
    parts = []
    long = ", lg AS (" + " UNION ALL ".join(
        f"SELECT region, arm, candidate, gate_pass, runaway, retained, '{d}' AS descriptor, {d} AS value FROM gd" for d in names
    ) + ")"
    for a in ("100us", "5ms"):
        for c in ("candidates", "gate_pass", "runaway", "retained"):
            flag = "candidate" if c == "candidates" else c
            parts.append(f'count(*) FILTER (WHERE arm = \'{a}\' AND {flag}) AS "{a}_{c}"')
        for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            parts.append(sql_round(f"quantile_cont(value, {p}) FILTER (WHERE arm = '{a}' AND retained)", 7) + f' AS "{a}_{q}"')
        parts.append(f'count(value) FILTER (WHERE arm = \'{a}\' AND retained) AS "{a}_n"')
    mw = mw_sql("(SELECT region || '|' || descriptor AS panel, arm, value FROM lg WHERE retained) k", "k.panel", "arm", "value", "100us", "5ms")
    return (
        FITS + long + ", " + mw
        + f", tb AS (SELECT region, descriptor, {', '.join(parts)} FROM lg GROUP BY ALL)"
        + f" SELECT tb.*, {sql_round('u', 1)} AS u, {sql_round('z')} AS z, {sql_round('cliffs_delta')} AS cliffs_delta, {sql_round(normal_p_sql('z'))} AS p FROM tb JOIN mw ON mw.panel = region || '|' || descriptor"
    )


@query("kinetics_table", "T8", kinetics_sql())
def kinetics_table(spark, sf_dir):
    out = stats.kinetics_table(fit_rows(spark, sf_dir), ["a", "tau", "i_ref"], ["region"], "arm", "100us", "5ms")
    quart = [f"{a}_{q}" for a in ("100us", "5ms") for q in ("q25", "median", "q75")]
    plain = ["region", "descriptor"] + [
        f"{a}_{c}" for a in ("100us", "5ms") for c in ("candidates", "gate_pass", "runaway", "retained", "n")
    ]
    return out.select(
        *plain, *[rounded(q, 7).alias(q) for q in quart],
        rounded("u", 1).alias("u"), rounded("z").alias("z"), rounded("cliffs_delta").alias("cliffs_delta"), rounded(stats.normal_p("z")).alias("p"),
    )


# Box summaries of each (priority, status); status pairs inside a priority, neighbouring priorities of a status.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ADJACENT = list(zip(PRIORITIES, PRIORITIES[1:]))


def brackets_sql() -> str:
    sides = [f"SELECT o_orderpriority || ' F vs P' AS panel, CASE o_orderstatus WHEN 'F' THEN 'first' ELSE 'second' END AS side, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'P')"]
    for a, b in ADJACENT:
        sides.append(f"SELECT o_orderstatus || ' {a} vs {b}', CASE o_orderpriority WHEN '{a}' THEN 'first' ELSE 'second' END, o_totalprice FROM orders WHERE o_orderpriority IN ('{a}', '{b}')")
    p = sql_round(normal_p_sql("CASE WHEN n1 >= 3 AND n2 >= 3 THEN z END"))
    return (
        "WITH sd AS (" + " UNION ALL ".join(sides) + "), " + mw_sql("sd", "panel", "side", "v", "first", "second")
        + f", bx AS (SELECT o_orderpriority || ' ' || o_orderstatus AS panel, count(*) AS n1, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders GROUP BY ALL)"
        + f" SELECT panel, n1, NULL::BIGINT AS n2, {sql_round('q25', 4)} AS q25, {sql_round('median', 4)} AS median, {sql_round('q75', 4)} AS q75, NULL::DOUBLE AS p, NULL::VARCHAR AS stars, NULL::DOUBLE AS cliffs_delta FROM bx"
        + f" UNION ALL SELECT panel, n1, n2, NULL, NULL, NULL, p, {STARS_SQL}, cliffs_delta FROM (SELECT panel, n1, n2, {p} AS p, CASE WHEN n1 >= 3 AND n2 >= 3 THEN {sql_round('cliffs_delta')} END AS cliffs_delta FROM mw WHERE n1 > 0 AND n2 > 0)"
    )


@query("box_brackets", "T14 T3 A10 A37", brackets_sql())
def box_brackets(spark, sf_dir):
    """Boxes with brackets by fate and between neighbours; a bracket with fewer than three rows on a side says nothing."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    boxes = quantiles(rows, ["o_orderpriority", "o_orderstatus"], "o_totalprice", {"q25": 0.25, "median": 0.5, "q75": 0.75}, count="n1")
    fates = stats.bracket_tests(rows, ["o_orderpriority"], "o_orderstatus", "o_totalprice", [("F", "P")], min_n=3).withColumnRenamed("o_orderpriority", "of")
    near = stats.bracket_tests(rows, ["o_orderstatus"], "o_orderpriority", "o_totalprice", ADJACENT, min_n=3).withColumnRenamed("o_orderstatus", "of")
    none = lambda kind: F.lit(None).cast(kind)
    boxes = boxes.select(
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("panel"), "n1", none("long").alias("n2"),
        *[rounded(q, 4).alias(q) for q in ("q25", "median", "q75")], none("double").alias("p"), none("string").alias("stars"), none("double").alias("cliffs_delta"),
    )
    both = fates.unionByName(near).filter("n1 > 0 and n2 > 0").withColumn("p", rounded(stats.normal_p("z")))
    delta = F.when((F.col("n1") >= 3) & (F.col("n2") >= 3), rounded("cliffs_delta")).alias("cliffs_delta")
    both = both.select(
        F.concat_ws(" ", "of", "pair").alias("panel"), "n1", "n2", *[none("double").alias(q) for q in ("q25", "median", "q75")], "p", stars(F.col("p")).alias("stars"), delta,
    )
    return boxes.unionByName(both)


SWEEP = [
    ("position_all", "l_linenumber", "a", "candidate"),
    ("tau_retained", "tau", "a", "retained"),
    ("r2_gate", "r2", "a", "gate_pass"),
    ("tau_runaway", "tau", "r2", "runaway"),
]


def sweep_sql() -> str:
    parts = []
    for name, x, y, gate in SWEEP:
        parts.append(
            f"SELECT region, '{name}' AS spec, {rank_sql('', 'region', x)} AS rx, {rank_sql('', 'region', y)} AS ry FROM gd WHERE {gate}"
        )
    return (
        FITS + ", sr AS (" + " UNION ALL ".join(parts)
        + f") SELECT region, spec, count(*) AS n, {sql_round('corr(rx, ry)')} AS rho FROM sr GROUP BY ALL"
    )


@query("sweep_table", "T9 F11 F17", sweep_sql())
def sweep_table(spark, sf_dir):
    specs = [(n, x, y, F.col(g)) for n, x, y, g in SWEEP]
    out = stats.correlation_sweep(fit_rows(spark, sf_dir), specs, ["region"])
    return out.select("region", "spec", "n", rounded("rho").alias("rho"))


@query(
    "blanked_values",
    "F14 F17",
    FITS
    + f""", m AS (SELECT quantile_cont(tau, 0.5) AS m FROM ft)
SELECT region, count(*) AS n, count(CASE WHEN gate_pass THEN a END) AS kept, {sql_round('avg(CASE WHEN gate_pass THEN a END)', 4)} AS mean_kept
FROM gd, m WHERE tau <= 1.5 * m GROUP BY region""",
)
def blanked_values(spark, sf_dir):
    rows = fit_rows(spark, sf_dir)
    mid = quantiles(rows, [], "tau", {"m": 0.5}).scalar()
    kept = rows.withColumn("_m", mid).filter(F.col("tau") <= 1.5 * F.col("_m"))
    value = cohorts.blank_unless(F.col("a"), F.col("gate_pass"))
    return kept.withColumn("v", value).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("kept"), rounded(F.avg("v"), 4).alias("mean_kept")
    )
