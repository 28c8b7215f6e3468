"""Counts and summaries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktraces.functions import labels as L
from sparktraces.functions import physics
from sparktraces.operators import cohorts, summaries
from sparktraces.operators.quantiles import quantiles
from sparktraces.plans.bindings import KEYS, MARKED, marked, traces
from sparktraces.plans.queries.labels import LABELLED, TAGGED, fated_orders, named_orders
from sparktraces.plans.registry import query, rounded, sql_round, table


def r(df, *names, digits=6):
    return [rounded(n, digits).alias(n) for n in names]


@query(
    "attrition_pivot",
    "A1 S3",
    TAGGED
    + "SELECT folder, count(*) AS total_candidates, "
    + ", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in L.BUCKETS)
    + " FROM (SELECT string_split(replace(folder, 'Bulk_', ''), '_')[1] AS folder, bucket FROM tagged) GROUP BY folder",
)
def attrition_pivot(spark, sf_dir):
    rows = named_orders(spark, sf_dir).select(
        F.split(F.replace(F.col("folder"), F.lit("Bulk_"), F.lit("")), "_")[0].alias("folder"),
        L.outcome_bucket(F.col("stem")).alias("bucket"),
    )
    return summaries.attrition(rows, ["folder"], "bucket")


@query(
    "scalar_max",
    "A2 A29 A39",
    f"""SELECT l_suppkey, max(l_quantity) AS max_l_quantity, max(l_extendedprice) AS max_l_extendedprice, max(l_discount) AS max_l_discount,
  max(l_tax) AS max_l_tax, {sql_round('avg(l_extendedprice)', 7)} AS mean_price, coalesce(max(CASE WHEN l_quantity > 49 THEN l_discount END), -1.0::DOUBLE) AS top_or_default
FROM lineitem GROUP BY l_suppkey""",
)
def scalar_max(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    most = summaries.column_maxima(rows, ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    large = F.when(F.col("l_quantity") > 49, F.col("l_discount"))
    more = rows.groupBy("l_suppkey").agg(
        rounded(F.avg("l_extendedprice"), 7).alias("mean_price"), summaries.safe_max(large, -1.0).alias("top_or_default")
    )
    return most.join(more, "l_suppkey")


@query(
    "group_sizes",
    "A3",
    "SELECT o_orderstatus, o_orderpriority, o_orderstatus || '_' || o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL",
)
def group_sizes(spark, sf_dir):
    label = F.concat_ws("_", "o_orderstatus", "o_orderpriority")
    return summaries.group_sizes(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], label)


STATUS_SQL = """
WITH s AS (SELECT l_linenumber AS trap, l_returnflag || l_linestatus AS status FROM lineitem),
c AS (SELECT trap, count(*) FILTER (WHERE status = 'AF') AS AF, count(*) FILTER (WHERE status = 'NF') AS NF, count(*) FILTER (WHERE status = 'NO') AS NO, count(*) FILTER (WHERE status = 'RF') AS RF FROM s GROUP BY trap)
"""


@query(
    "status_crosstab",
    "A4 J9",
    STATUS_SQL
    + "SELECT CAST(k AS BIGINT) AS trap, coalesce(AF, 0) AS AF, coalesce(NF, 0) AS NF, coalesce(NO, 0) AS NO, coalesce(RF, 0) AS RF FROM (SELECT k FROM range(1, 19) x(k) UNION SELECT trap FROM c) LEFT JOIN c ON c.trap = k",
)
def status_crosstab(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("trap"), F.concat("l_returnflag", "l_linestatus").alias("status")
    )
    counts = summaries.counts_wide(rows, ["trap"], "status", ["AF", "NF", "NO", "RF"])
    return cohorts.whole_range(counts, "trap", 1, 18)


@query(
    "status_by_group_with_all",
    "A5 U6 A7",
    """
SELECT c_mktsegment, coalesce(CAST(c_nationkey AS VARCHAR), 'All') AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS negative
FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment))
""",
)
def status_by_group_with_all(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation")
    return cohorts.pool_with_total(
        rows, ["c_mktsegment", "nation"],
        {"n": F.count(F.lit(1)), "negative": F.count_if(F.col("c_acctbal") < 0)},
    )


@query(
    "fate_fractions",
    "A6 J8 U5",
    LABELLED
    + f""", o AS (SELECT treatment, duration_label, count(*) FILTER (WHERE fate = 'intact') AS intact, count(*) FILTER (WHERE fate = 'ruptured_post') AS ruptured_post
  FROM fated WHERE condition_type = 'EP' AND duration_label <> '2s' GROUP BY ALL),
x AS (SELECT treatment, duration_label, count(*) AS excluded FROM fated WHERE condition_type = 'EP' AND ends_with(stem, '_DOA') GROUP BY ALL),
b AS (SELECT coalesce(o.treatment, x.treatment) AS treatment, coalesce(o.duration_label, x.duration_label) AS duration_label,
    coalesce(intact, 0) AS intact, coalesce(ruptured_post, 0) AS ruptured_post, coalesce(excluded, 0) AS excluded
  FROM o FULL JOIN x ON o.treatment = x.treatment AND o.duration_label = x.duration_label)
SELECT *, intact + ruptured_post AS analysis_total, intact + ruptured_post + excluded AS candidate_total,
  {sql_round('ruptured_post / nullif(intact + ruptured_post, 0)')} AS fraction_ruptured,
  {sql_round('excluded / nullif(intact + ruptured_post + excluded, 0)')} AS fraction_excluded FROM b""",
)
def fate_fractions(spark, sf_dir):
    rows = fated_orders(spark, sf_dir).filter(F.col("condition_type") == "EP")
    by = ["treatment", "duration_label"]
    outcomes = summaries.counts_wide(rows.filter(F.col("duration_label") != "2s"), by, "fate", ["intact", "ruptured_post"])
    excluded = rows.filter(F.col("stem").endswith("_DOA")).groupBy(*by).agg(F.count(F.lit(1)).alias("excluded"))
    out = summaries.fate_fractions(outcomes, excluded, by)
    return out.select(
        *by, "intact", "ruptured_post", "excluded", "analysis_total", "candidate_total",
        *r(out, "fraction_ruptured", "fraction_excluded"),
    )


@query(
    "behaviour_fractions",
    "A9 A8",
    f"""
WITH b AS (SELECT l_returnflag, CASE WHEN l_discount - 0.05 > 0.02 THEN 'Extends' WHEN l_discount - 0.05 < -0.02 THEN 'Retracts' ELSE 'Stable' END AS k FROM lineitem),
c AS (SELECT l_returnflag, count(*) FILTER (WHERE k = 'Extends') AS Extends, count(*) FILTER (WHERE k = 'Stable') AS Stable, count(*) FILTER (WHERE k = 'Retracts') AS Retracts FROM b GROUP BY 1)
SELECT *, Extends + Stable + Retracts AS row_total, {sql_round('Extends / (Extends + Stable + Retracts)')} AS Extends_share,
  {sql_round('Stable / (Extends + Stable + Retracts)')} AS Stable_share, {sql_round('Retracts / (Extends + Stable + Retracts)')} AS Retracts_share FROM c
""",
)
def behaviour_fractions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", physics.behaviour_class(F.col("l_discount") - 0.05).alias("k")
    )
    kinds = ["Extends", "Stable", "Retracts"]
    out = summaries.shares(summaries.counts_wide(rows, ["l_returnflag"], "k", kinds), kinds)
    return out.select("l_returnflag", *kinds, "row_total", *r(out, *[f"{k}_share" for k in kinds]))


@query(
    "box_summary",
    "A10 A16 A30",
    f"""
SELECT l_returnflag, l_linenumber, {sql_round('quantile_cont(l_extendedprice, 0.25)', 4)} AS q25, {sql_round('quantile_cont(l_extendedprice, 0.5)', 4)} AS median,
  {sql_round('quantile_cont(l_extendedprice, 0.75)', 4)} AS q75, count(*) AS n FROM lineitem GROUP BY ALL
""",
)
def box_summary(spark, sf_dir):
    out = summaries.box(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice")
    return out.select("l_returnflag", "l_linenumber", *r(out, "q25", "median", "q75", digits=4), "n")


@query(
    "replicate_sem",
    "A11",
    f"""
WITH m AS (SELECT r_name, n_name, avg(c_acctbal) AS m FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)
SELECT r_name, {sql_round('avg(m)', 7)} AS mean, {sql_round('coalesce(stddev_samp(m) / sqrt(count(m)), 0)', 7)} AS sem, count(m) AS replicates FROM m GROUP BY r_name
""",
)
def replicate_sem(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    out = summaries.replicate_mean(rows, ["r_name"], ["n_name"], "c_acctbal")
    return out.select("r_name", *r(out, "mean", "sem", digits=7), "replicates")


SPANS = (
    MARKED
    + """, sp AS (SELECT trace_id, condition, arm, count(*) AS rows, max(t) - min(t) AS duration, max(marker_frame) AS marker,
  max(CASE WHEN frame = marker_frame THEN t END) - min(t) AS pre_duration, max(t) - max(CASE WHEN frame = marker_frame THEN t END) AS post_duration
  FROM mk GROUP BY trace_id, condition, arm)
"""
)


def spans_of(spark, sf_dir):
    return summaries.trace_spans(marked(traces(spark, sf_dir)), KEYS, ["condition", "arm"], "t", "marker_frame")


@query(
    "window_constants",
    "A12 J13",
    SPANS
    + f""", w AS (SELECT condition, arm, quantile_cont(duration, 0.5) AS m FROM sp WHERE rows >= 15 GROUP BY ALL),
p AS (SELECT arm, quantile_cont(pre_duration, 0.5) AS p FROM sp WHERE rows >= 15 AND condition = 'EP' AND marker >= 15 GROUP BY arm),
k AS (SELECT min(m) AS whole_window, min(m) FILTER (WHERE condition = 'ASP') AS control_window, (SELECT min(p) FROM p) AS pre_window FROM w)
SELECT trace_id, {sql_round('whole_window')} AS whole_window, {sql_round('control_window')} AS control_window, {sql_round('pre_window')} AS pre_window,
  {sql_round("least(duration, CASE condition WHEN 'ASP' THEN control_window ELSE whole_window END)")} AS used FROM sp, k""",
)
def window_constants(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    one = summaries.window_constants(spans, ["arm"], "condition")
    names = ["whole_window", "control_window", "pre_window"]
    rows = spans.withColumn("_k", one.select(F.struct(*names)).scalar()).select("*", "_k.*")
    used = F.least("duration", F.when(F.col("condition") == "ASP", F.col("control_window")).otherwise(F.col("whole_window")))
    return rows.select("trace_id", *r(rows, *names), rounded(used).alias("used"))


@query(
    "common_duration",
    "A13 A14",
    SPANS
    + f""", m AS (SELECT arm, avg(duration) AS m, count(*) AS n FROM sp GROUP BY arm),
a AS (SELECT sp.arm, min(duration) AS common, count(*) AS kept FROM sp JOIN m ON m.arm = sp.arm WHERE n >= 2 AND duration >= 0.5 * m GROUP BY sp.arm HAVING count(*) >= 2),
b AS (SELECT arm, least(min(post_duration), 300.0) AS common_post FROM sp WHERE post_duration > 0 GROUP BY arm HAVING count(*) >= 2)
SELECT a.arm, {sql_round('common')} AS common, kept, {sql_round('common_post')} AS common_post FROM a JOIN b ON a.arm = b.arm""",
)
def common_duration(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    out = summaries.common_duration(spans, ["arm"], "duration").join(
        summaries.common_post_duration(spans, ["arm"], "post_duration", cap=300.0), "arm"
    )
    return out.select("arm", rounded("common").alias("common"), "kept", rounded("common_post").alias("common_post"))


@query(
    "axis_limits",
    "A15 A38",
    SPANS
    + f""", e AS (SELECT arm, -pre_duration AS t_min, post_duration AS t_max FROM sp WHERE marker IS NOT NULL),
m AS (SELECT arm, quantile_cont(t_max, 0.5) AS mid FROM e WHERE t_max > 0 GROUP BY arm),
x AS (SELECT e.arm, coalesce(min(t_max) FILTER (WHERE t_max >= 0.2 * mid), min(t_max)) AS x_max FROM e JOIN m ON m.arm = e.arm WHERE t_max > 0 GROUP BY e.arm),
s AS (SELECT arm, greatest(quantile_cont(t_min, 0.5), -30.0) AS x_min FROM e GROUP BY arm),
c AS (SELECT max(p) * 1.1 AS cap FROM (SELECT quantile_cont(y, 0.99) AS p FROM tr GROUP BY channel))
SELECT x.arm, {sql_round('x_min')} AS x_min, {sql_round('x_max')} AS x_max, {sql_round('cap')} AS cap FROM x JOIN s ON s.arm = x.arm, c""",
)
def axis_limits(spark, sf_dir):
    spans = spans_of(spark, sf_dir).filter(F.col("marker").isNotNull())
    extents = spans.select("arm", (-F.col("pre_duration")).alias("t_min"), F.col("post_duration").alias("t_max"))
    events = table(spark, sf_dir, "events").select("event_type", "value")
    cap = summaries.upper_cap(events, ["event_type"], "value").scalar()
    out = summaries.axis_limits(extents, ["arm"]).withColumn("cap", cap)
    return out.select("arm", *r(out, "x_min", "x_max", "cap"))


@query(
    "position_matrix",
    "A17 A26",
    "SELECT l_returnflag || l_linestatus AS replicate, "
    + ", ".join(f"{sql_round(f'avg(l_quantity) FILTER (WHERE l_linenumber = {i})')} AS c{i}" for i in range(1, 19))
    + ", count(*) FILTER (WHERE l_linenumber NOT BETWEEN 1 AND 18) AS outside FROM lineitem GROUP BY 1",
)
def position_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("replicate", F.concat("l_returnflag", "l_linestatus"))
    out = summaries.matrix(rows, "replicate", "l_linenumber", range(1, 19), "l_quantity")
    return out.select("replicate", *r(out, *[f"c{i}" for i in range(1, 19)]), "outside")


@query(
    "prepulse_size",
    "A18 A19 O6",
    MARKED
    + f""", e AS (SELECT *, CASE WHEN marker_frame > 0 AND marker_frame < n_rows THEN marker_frame ELSE n_rows END AS stop FROM mk),
m AS (SELECT trace_id, quantile_cont(y, 0.5) FILTER (WHERE frame < stop AND frame >= stop - 10) AS y_before,
  max(y) FILTER (WHERE y > 0 AND frame < stop) AS max_before FROM e GROUP BY trace_id)
SELECT trace_id, {sql_round('y_before')} AS y_before, {sql_round('max_before')} AS max_before,
  {sql_round('4 / (3 * sqrt(pi())) * (y_before * sqrt(y_before))')} AS volume_before FROM m""",
)
def prepulse_size(spark, sf_dir):
    rows = marked(traces(spark, sf_dir))
    size = summaries.with_sphere_volume(
        summaries.last_before_marker(rows, KEYS, "marker_frame", ["y"], n_rows="n_rows"), "y_before"
    )
    inside = (F.col("marker_frame") > 0) & (F.col("marker_frame") < F.col("n_rows"))
    stop = F.when(inside, F.col("marker_frame")).otherwise(F.col("n_rows"))
    longest = rows.groupBy(*KEYS).agg(F.max(F.when((F.col("y") > 0) & (F.col("frame") < stop), F.col("y"))).alias("max_before"))
    out = size.join(longest, KEYS)
    return out.select("trace_id", *r(out, "y_before", "max_before", "volume_before"))


@query(
    "prepost_mean",
    "A20 A21 A31",
    MARKED
    + f""", v AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 0 ELSE y END AS v, CASE WHEN channel = 'view' THEN y END AS f,
    coalesce(condition = 'EP' AND marker_frame > 0 AND marker_frame < n_rows, false) AS pulsed FROM mk),
a AS (SELECT trace_id, arg_min(f, frame) FILTER (WHERE f > 0) AS f0, avg(v) FILTER (WHERE v > 0 AND (NOT pulsed OR frame < marker_frame)) AS pre,
    avg(v) FILTER (WHERE v > 0 AND pulsed AND frame >= marker_frame) AS post, max(v) FILTER (WHERE NOT pulsed OR frame < marker_frame) AS max_pre,
    max(v) FILTER (WHERE pulsed AND frame >= marker_frame) AS max_post FROM v GROUP BY trace_id)
SELECT trace_id, {sql_round('f0')} AS f0, {sql_round('pre / f0')} AS pre_norm, {sql_round('post / f0')} AS post_norm, {sql_round('max_pre')} AS max_pre, {sql_round('max_post')} AS max_post FROM a""",
)
def prepost_mean(spark, sf_dir):
    c = F.col
    rows = (
        marked(traces(spark, sf_dir))
        .withColumn("v", F.when(c("event_id") % 5 != 0, c("y")).otherwise(0.0))
        .withColumn("f", F.when(c("channel") == "view", c("y")))
    )
    norm = summaries.pre_post_over_baseline(rows, KEYS, "v", "f", "marker_frame", "condition", n_rows="n_rows")
    pulsed = F.coalesce((c("condition") == "EP") & (c("marker_frame") > 0) & (c("marker_frame") < c("n_rows")), F.lit(False))
    peaks = rows.groupBy(*KEYS).agg(
        F.max(F.when(~pulsed | (c("frame") < c("marker_frame")), c("v"))).alias("max_pre"),
        F.max(F.when(pulsed & (c("frame") >= c("marker_frame")), c("v"))).alias("max_post"),
    )
    out = norm.join(peaks, KEYS)
    return out.select("trace_id", *r(out, "f0", "pre_norm", "post_norm", "max_pre", "max_post"))


@query(
    "baseline_f0",
    "A22",
    MARKED
    + f""", i AS (SELECT *, frame >= CASE WHEN marker_frame IS NULL THEN 0 ELSE greatest(0, marker_frame - 4) END AND frame < coalesce(marker_frame, 4) AS ins FROM mk),
a AS (SELECT trace_id, avg(y) FILTER (WHERE ins AND channel = 'view') AS body, avg(y) FILTER (WHERE ins AND channel = 'click') AS prot,
  avg(y) FILTER (WHERE ins AND channel = 'signup') AS tip, avg(y) FILTER (WHERE ins AND channel IN ('view', 'click')) AS total, avg(y) FILTER (WHERE ins) AS img FROM i GROUP BY trace_id)
SELECT trace_id, {sql_round('coalesce(CASE WHEN total IS NOT NULL THEN body END, total, img, 0)')} AS f0_body,
  {sql_round('coalesce(CASE WHEN total IS NOT NULL THEN prot END, total, img, 0)')} AS f0_prot,
  {sql_round('coalesce(CASE WHEN total IS NOT NULL THEN coalesce(tip, prot) END, total, img, 0)')} AS f0_tip, {sql_round('coalesce(total, img, 0)')} AS f0_total FROM a""",
)
def baseline_f0(spark, sf_dir):
    c = F.col
    rows = marked(traces(spark, sf_dir)).select(
        "*",
        F.when(c("channel") == "view", c("y")).alias("body"),
        F.when(c("channel") == "click", c("y")).alias("prot"),
        F.when(c("channel") == "signup", c("y")).alias("tip"),
        F.when(c("channel").isin("view", "click"), c("y")).alias("total"),
    )
    regions = {k: k for k in ("body", "prot", "tip", "total")}
    out = summaries.baselines(rows, KEYS, regions, "marker_frame", rows=4, fallback="y")
    return out.select("trace_id", *r(out, "f0_body", "f0_prot", "f0_tip", "f0_total"))


@query(
    "remodel_ratio",
    "A23",
    MARKED
    + f""", p AS (SELECT trace_id, avg(y) FILTER (WHERE CASE WHEN marker_frame IS NULL THEN frame < 5 ELSE frame >= marker_frame - 5 AND frame < marker_frame END) AS pre_mean,
  avg(y) FILTER (WHERE CASE WHEN marker_frame IS NULL THEN frame >= n_rows - 10 ELSE frame > marker_frame AND frame <= marker_frame + 10 END) AS post_mean FROM mk GROUP BY trace_id)
SELECT trace_id, {sql_round('pre_mean')} AS pre_mean, {sql_round('post_mean')} AS post_mean,
  {sql_round('post_mean / CASE WHEN pre_mean IS NULL THEN 1e-6 ELSE greatest(pre_mean, 1e-6) END', 2)} AS ratio, {sql_round('post_mean - pre_mean')} AS difference FROM p""",
)
def remodel_ratio(spark, sf_dir):
    out = summaries.remodelling(marked(traces(spark, sf_dir)), KEYS, "y", "marker_frame", n_rows="n_rows")
    return out.select("trace_id", *r(out, "pre_mean", "post_mean", "difference"), rounded("ratio", 2).alias("ratio"))


@query(
    "norm_delta",
    "A24 A25",
    MARKED
    + f""", s AS (SELECT *, CASE WHEN y > 20 THEN y / 100 END AS shape FROM mk),
b AS (SELECT trace_id, min(frame) FILTER (WHERE shape IS NOT NULL) AS a, max(frame) FILTER (WHERE shape IS NOT NULL) + 1 AS z FROM s GROUP BY trace_id HAVING count(shape) >= 3),
j AS (SELECT s.*, a, z, coalesce(marker_frame > a AND marker_frame < z, false) AS split FROM s JOIN b ON b.trace_id = s.trace_id),
k AS (SELECT *, CASE WHEN split THEN marker_frame ELSE z END AS mid FROM j),
g AS (SELECT trace_id, bool_or(split) AS split, avg(y) FILTER (WHERE frame >= a AND frame < a + 3) AS b1, avg(y) FILTER (WHERE frame >= greatest(a, mid - 3) AND frame < mid) AS e1,
  avg(y) FILTER (WHERE frame >= mid AND frame < mid + 3) AS b2, avg(y) FILTER (WHERE frame >= greatest(mid, z - 3) AND frame < z) AS e2,
  avg(shape) FILTER (WHERE frame >= a AND frame < mid) AS m1, stddev_pop(shape) FILTER (WHERE frame >= a AND frame < mid) AS s1,
  avg(shape) FILTER (WHERE split AND frame >= mid AND frame < z) AS m2, stddev_pop(shape) FILTER (WHERE split AND frame >= mid AND frame < z) AS s2 FROM k GROUP BY trace_id)
SELECT trace_id, {sql_round('CASE WHEN b1 > 0 THEN (e1 - b1) / b1 * 100 ELSE 0 END', 4)} AS pre_change, {sql_round('CASE WHEN split THEN CASE WHEN b2 > 0 THEN (e2 - b2) / b2 * 100 ELSE 0 END END', 4)} AS post_change,
  {sql_round('m1', 9)} AS pre_shape_mean, {sql_round('s1', 9)} AS pre_shape_sd, {sql_round('m2', 9)} AS post_shape_mean, {sql_round('s2', 9)} AS post_shape_sd FROM g""",
)
def norm_delta(spark, sf_dir):
    rows = (
        marked(traces(spark, sf_dir))
        .withColumn("shape", F.when(F.col("y") > 20, F.col("y") / 100))
        .withColumn("event", F.lit(None).cast("long"))
    )
    out = summaries.phase_changes(rows, KEYS, "y", "shape", "marker_frame", "event")
    shapes = ["pre_shape_mean", "pre_shape_sd", "post_shape_mean", "post_shape_sd"]
    return out.select("trace_id", *r(out, "pre_change", "post_change", digits=4), *r(out, *shapes, digits=9))


@query(
    "dose_stats",
    "A26",
    f"""
SELECT p_brand, p_type, count(p_retailprice) AS n, {sql_round('avg(p_retailprice)', 7)} AS mean, {sql_round('stddev_samp(p_retailprice)', 7)} AS sd,
  {sql_round('stddev_samp(p_retailprice) / sqrt(count(p_retailprice))', 7)} AS sem, {sql_round('median(p_retailprice)', 7)} AS median,
  min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY ALL
""",
)
def dose_stats(spark, sf_dir):
    out = summaries.dose_table(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_retailprice")
    return out.select("p_brand", "p_type", "n", *r(out, "mean", "sd", "sem", "median", digits=7), "low", "high")


HIST = """
WITH h AS (SELECT l_returnflag AS drug, l_suppkey AS img, l_discount * 10 AS c FROM lineitem),
b AS (SELECT *, (SELECT count(*) FROM range(20) e(k) WHERE c >= k * 0.05::DOUBLE) AS bin FROM h WHERE c BETWEEN 0 AND 1)
"""


@query(
    "histogram_sem",
    "A27",
    HIST
    + f""", u AS (SELECT drug, count(DISTINCT img) AS u FROM h GROUP BY drug),
i AS (SELECT DISTINCT drug, img FROM h), e AS (SELECT drug, img, CAST(k AS BIGINT) AS bin FROM i, range(1, 21) r(k)),
c AS (SELECT e.drug, e.img, e.bin, count(b.c) AS c FROM e LEFT JOIN b ON b.drug = e.drug AND b.img = e.img AND b.bin = e.bin GROUP BY ALL)
SELECT drug, bin, {sql_round('avg(c)')} AS mean, {sql_round('stddev_samp(c) / sqrt(count(*))')} AS sem FROM c GROUP BY drug, bin""",
)
def histogram_sem(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("drug"), F.col("l_suppkey").alias("img"), (F.col("l_discount") * 10).alias("c")
    )
    out = summaries.histogram_mean(rows, "drug", "img", "c")
    return out.select("drug", "bin", *r(out, "mean", "sem"))


@query(
    "histogram_density",
    "A28",
    HIST
    + f"SELECT drug, bin, count(*) AS count, {sql_round('count(*) / (sum(count(*)) OVER (PARTITION BY drug) * 0.05::DOUBLE)')} AS density FROM b GROUP BY drug, bin",
)
def histogram_density(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("drug"), (F.col("l_discount") * 10).alias("c"))
    out = summaries.density(rows, "drug", "c", lo=0.0, hi=1.0, bins=20)
    return out.select("drug", "bin", "count", rounded("density").alias("density"))


@query(
    "pooled_baseline",
    "A32",
    f"""SELECT CASE WHEN user_id % 2 = 0 THEN '100us' ELSE '5ms' END AS arm, {sql_round('avg(value)', 8)} AS mean, {sql_round('stddev_pop(value)')} AS sd,
  {sql_round('quantile_cont(value, 0.95)')} AS p95, count(*) AS n FROM events GROUP BY 1""",
)
def pooled_baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "100us").otherwise("5ms").alias("arm"), "value"
    )
    stats = rows.groupBy("arm").agg(
        rounded(F.avg("value"), 8).alias("mean"), rounded(F.stddev_pop("value")).alias("sd"), F.count(F.lit(1)).alias("n")
    )
    tail = quantiles(rows, ["arm"], "value", {"p95": 0.95})
    return stats.join(tail.withColumn("p95", rounded("p95")), "arm")
