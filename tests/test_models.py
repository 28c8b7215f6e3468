"""Ground truth: formulas with known values and fits of traces whose parameters are known."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktraces.functions import labels, measures, physics
from sparktraces.operators import events, fit, pixels, stats
from sparktraces.operators.events import Settings

R, DP, C = 5.0, 1000.0, 1.0


def jeffreys(t, e, eta1, eta2):
    tau = 3 * math.pi * eta1 / (C * e)
    return R * DP / (C * e) * (1 - np.exp(-t / tau)) + R * DP / (3 * math.pi * eta2) * t


def trace(spark, values, times=None):
    t = np.arange(len(values), dtype=float) if times is None else times
    pdf = pd.DataFrame({"trace_id": 1, "frame": np.arange(len(values)), "t": t, "y": values, "n_rows": len(values)})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("w,h,want", [(10, 0.5, 0.9365), (10, 1, 0.8820), (10, 2, 0.7946), (10, 5, 0.6478), (10, 10, 0.5928)])
def test_shape_factor_table(spark, w, h, want):
    got = spark.range(1).select(physics.shape_factor(F.lit(float(w)), F.lit(float(h)))).first()[0]
    assert abs(got - want) < 0.005


def test_effective_radius(spark):
    got = spark.range(1).select(physics.effective_radius(F.lit(6.7), F.lit(5.0))).first()[0]
    assert abs(got - 3.134798) < 1e-5


def test_shear_recovers_viscosity(spark):
    m = physics.shear(*[F.lit(float(v)) for v in (10, 5, 100, 1000, 0.001)])
    stress, rate = spark.range(1).select(m["wall_stress_pa"], m["wall_rate_per_s"]).first()
    assert 0.0005 < stress / rate < 0.002


def test_jeffreys_parameters_are_recovered(spark):
    t = np.arange(100.0)
    points = trace(spark, jeffreys(t, 3000.0, 5000.0, 15000.0))
    fits = fit.fit_viscoelastic(points, ["trace_id"], R * DP, C, check_flow=False).toPandas().set_index("model")
    j = fits.loc["Jeffreys"]
    assert j.r2 > 0.99999
    assert abs(j.e / 3000 - 1) < 1e-3 and abs(j.eta1 / 5000 - 1) < 1e-2 and abs(j.eta2 / 15000 - 1) < 1e-3


def test_fits_stay_inside_their_bounds(spark):
    rng = np.random.default_rng(1)
    points = trace(spark, rng.exponential(50, 60))
    fits = fit.viscoelastic_parameters(fit.fit_models(points, ["trace_id"], fit.viscoelastic_models(R * DP, C)), R * DP, C)
    for row in fits.toPandas().itertuples():
        assert 1 * 0.999 <= row.e <= 1e5 * 1.001 and 1 * 0.999 <= row.eta1 <= 5e5 * 1.001
        if row.model != "Kelvin-Voigt":
            assert 500 * 0.999 <= row.eta2 <= 1e6 * 1.001


def test_bounded_solver_beats_every_grid_point():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    g, b = x.T @ x, x.T @ y
    sums = pd.DataFrame({"yy": [y @ y], **{f"b{i + 1}": [b[i]] for i in range(3)}, **{f"g{i + 1}{j + 1}": [g[i, j]] for i in range(3) for j in range(i, 3)}})
    box = pd.DataFrame({**{f"lo{i}": [-0.05] for i in (1, 2, 3)}, **{f"hi{i}": [0.02] for i in (1, 2, 3)}})
    model = fit.viscoelastic_models(1.0, 1.0)[2]
    got = fit.bounded_least_squares(sums, box, model.patterns()).iloc[0]
    grid = np.stack(np.meshgrid(*[np.linspace(-0.05, 0.02, 29)] * 3), -1).reshape(-1, 3)
    rss = ((y[None, :] - grid @ x.T) ** 2).sum(1)
    assert got.rss <= rss.min() + 1e-9


def test_two_rises_are_told_apart(spark):
    t = np.linspace(0, 300, 200)
    y = 40 * (1 - np.exp(-t / 5)) + 60 * (1 - np.exp(-t / 80))
    got = fit.fit_rises(trace(spark, y, t), ["trace_id"]).toPandas().iloc[0]
    assert got.model == "Bi" and got.r2_flag
    assert abs(got.tau1 / 5 - 1) < 0.1 and abs(got.tau2 / 80 - 1) < 0.1


def test_step_raises_an_alarm(spark):
    f = np.arange(100)
    y = np.where(f < 50, 100.0, np.minimum(135.0, 100 + 7.0 * (f - 49))) + np.sin(f * 12.9898)
    df = trace(spark, y).withColumn("len", F.lit(10.0)).withColumn("area", F.lit(50.0))
    entry = events.sustained_entry(df, ["trace_id"], "len", "area")
    bounds = events.sustained_exit(df, ["trace_id"], "len", entry)
    got = events.alarms(events.active_rows(df, ["trace_id"], bounds, "y", Settings()), ["trace_id"], "y", Settings()).first()
    assert abs(got.spike - 50) <= 5 and abs(got.drift - 50) <= 5


def test_plausibility(spark):
    ranges = {"e": (100.0, 1000.0), "eta1": (100.0, 1000.0), "eta2": (100.0, 1000.0)}
    good = physics.plausibility(F.lit(500.0), F.lit(500.0), F.lit(500.0), ranges)
    bad = physics.plausibility(F.lit(-500.0), F.lit(500.0), F.lit(500.0), ranges)
    row = spark.range(1).select(good["valid"].alias("g"), bad["valid"].alias("b"), bad["warnings"].alias("w")).first()
    assert row.g and not row.b and row.w


def test_kelvin_voigt_is_the_limit_of_jeffreys(spark):
    t = F.col("id").cast("double")
    kv = physics.kelvin_voigt(t, F.lit(1.6), F.lit(15.0))
    jf = physics.jeffreys(t, F.lit(1.6), F.lit(15.0), F.lit(R * DP / (3 * math.pi * 1e12)))
    assert spark.range(1, 100).select(F.max(F.abs(jf / kv - 1))).first()[0] < 0.01


def test_edge_between_pixels(spark):
    x = np.arange(90, 131)
    v = np.clip(50 + 130 * (x - 118) / 3, 50, 180)
    df = spark.createDataFrame(pd.DataFrame({"im": 1, "x": x, "v": v, "edge": 120}))
    got = pixels.subpixel_edge(df, ["im"], "x", "v", "edge").first().edge_x
    assert abs(got - 119.5) < 0.5


def test_p_values(spark):
    row = spark.range(1).select(
        stats.normal_p(F.lit(1.959963985)).alias("z"),
        stats.student_p(F.lit(2.228138852), F.lit(10.0)).alias("t"),
        stats.chi2_p(F.lit(5.991464547), F.lit(2.0)).alias("c"),
    ).first()
    assert all(abs(v - 0.05) < 1e-7 for v in row)


def test_missing_marks(spark):
    row = spark.range(1).select(
        measures.missing(F.lit("nan")).alias("a"), measures.missing(F.lit("x")).alias("b"), measures.missing(F.lit("1.5")).alias("c")
    ).first()
    assert row.a is None and row.b is None and row.c == 1.5


def test_folder_grammar(spark):
    names = ["260128_MDAMB231_WT_Chip1_Experiment3-1100Pa-100V-5ms-frame10", "260128_MDAMB231_WT_Chip1_Experiment3_1100PA_0V_100µs_FRAME7_x", "notes"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(labels.parse_folder(F.col("n")).alias("f")).collect()
    assert rows[0].f.duration_ms == 5.0 and rows[0].f.duration_label == "5ms" and rows[0].f.condition_type == "EP"
    assert rows[1].f.duration_ms == 0.1 and rows[1].f.duration_label == "100us" and rows[1].f.condition_type == "ASP"
    assert rows[2].f is None


def test_long_traces_fit_as_short_ones(spark, monkeypatch):
    rng = np.random.default_rng(4)
    t = np.arange(80.0)
    parts = []
    for k, n in enumerate((80, 80, 20)):
        y = jeffreys(t[:n], 3000.0 + 500 * k, 5000.0, 15000.0) + rng.standard_normal(n) * 0.02
        parts.append(pd.DataFrame({"trace_id": k, "frame": np.arange(n), "t": t[:n], "y": y}))
    points = spark.createDataFrame(pd.concat(parts))
    models = [fit.LINE, fit.POWER_LAW, *fit.viscoelastic_models(R * DP, C)]
    order = ["trace_id", "model"]
    together = fit.fitted(points, ["trace_id"], models).toPandas().set_index(order).sort_index()
    monkeypatch.setattr(fit, "CHUNK_ROWS", 40)
    apart = fit.fitted(points, ["trace_id"], models).toPandas().set_index(order).sort_index()
    assert list(together.index) == list(apart.index) and len(together) == 15
    for column in ("s1", "c1", "c2", "c3", "rss", "dw", "r2", "aicc", "aic"):
        assert np.allclose(together[column], apart[column], rtol=1e-6, atol=1e-9), column


def test_failed_fits_give_no_row(spark):
    rows = [(1, i, 2.0, float(i)) for i in range(20)] + [(2, i, float(i), 0.0) for i in range(20)] + [(3, 0, 0.0, 1.0)]
    points = spark.createDataFrame(rows, "trace_id int, frame int, t double, y double")
    got = fit.fitted(points, ["trace_id"], [fit.LINE, fit.POWER_LAW]).toPandas()
    assert set(got.trace_id) == {2} and set(got.model) == {"Linear", "Power-Law"} and (got.rss < 1e-12).all()
    assert fit.fitted(points.limit(0), ["trace_id"], [fit.LINE]).collect() == []


def test_models_by_kind(spark):
    rows = [(1, kind, i, float(i), 2.0 * i + 1) for kind in ("a", "b", "c") for i in range(20)]
    points = spark.createDataFrame(rows, "trace_id int, kind string, frame int, t double, y double")
    got = fit.fitted(points, ["trace_id", "kind"], {"a": [fit.LINE], "b": [fit.POWER_LAW, fit.LINE]}, by="kind").toPandas()
    assert sorted(zip(got.kind, got.model)) == [("a", "Linear"), ("b", "Linear"), ("b", "Power-Law")]
