"""Steps that must not cost more as keys, batches or folders grow, and queries that must keep their steps."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from sparktraces.operators import fit, stage
from sparktraces.operators.events import Settings
from sparktraces.plans.queries.labels import parsed_orders
from sparktraces.plans.queries.ordered import outlier_std11
from sparktraces.plans.queries.side_tables import sniffed_columns
from sparktraces.streaming import live

START = dt.datetime(2024, 1, 1)


def test_deviation_cleaning_leaves_missing_values_out(spark, tmp_path):
    rows = [(i, START + dt.timedelta(minutes=i), 1, "view", 5.0 + i % 3) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(r["event_id"] for r in outlier_std11(spark, str(tmp_path)).collect())
    # every 17th value is missing, and two of the 56 rows that are left are the leading twentieth
    assert got == [i for i in range(60) if i % 17][2:]


def test_sniffed_files_do_not_grow_with_users(spark, tmp_path):
    rows = [(i, START + dt.timedelta(seconds=i), i % 90 if i < 270 else None, i / 2) for i in range(274)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1)
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["experiment"]: (r["n"], r["t"], r["length"]) for r in sniffed_columns(spark, str(tmp_path)).collect()}
    base = (START - dt.datetime(1970, 1, 1)).total_seconds()
    assert len(got) == 91 and got[7] == (3, base + 187, (7 + 97 + 187) / 2) and got[None][0] == 4
    root = next(p for p in reversed(stage._created) if "/unknown-" in p)
    assert len([f for f in os.listdir(root) if f.startswith("experiment=")]) <= 64


def test_folder_names_are_matched_once(spark, tmp_path):
    orders = spark.createDataFrame([(k, k, "O", dt.date(2024, 1, 2)) for k in range(8)] + [(9, 9, "P", dt.date(2024, 1, 2))], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    rows = parsed_orders(spark, str(tmp_path))
    shown = rows.select("order_id", "voltage_v", "duration_label", "duration_ms", "pulse_frame")
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    got = {r["order_id"]: (r["voltage_v"], r["duration_label"], r["duration_ms"], r["pulse_frame"]) for r in shown.collect()}
    assert got[1] == (100, "5ms", 5.0, 1) and got[2] == (100, "100us", 0.1, 2) and got[0] == (0, "2s", 2000.0, 0)
    assert 9 not in got and len(got) == 8


def test_alarms_keep_few_parts_of_state(spark):
    settings = Settings(settling=1, baseline=5, lag=2, spike_sigma=3.0)
    rng = np.random.default_rng(4)
    values = {k: rng.standard_normal(40) + 30.0 * (np.arange(40) >= 25) for k in range(6)}
    rows = spark.createDataFrame([(k, START + dt.timedelta(minutes=i), float(v)) for k, ys in values.items() for i, v in enumerate(ys)], "k int, at timestamp, y double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        stream, close = live.closing(live.replayed(rows, F.unix_seconds("at"), 3), "at")
        got = live.drain(live.online_alarms(stream, "k", "at", "y", settings=settings, buckets=2), "few", close=close).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [(k, i, kind) for k, ys in values.items() for i, kind in live.advance((0, [], 0.0, []), ys, settings)[1]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 6
    state = next(p for p in reversed(stage._created) if "/few-" in p)
    parts = [p for p in os.listdir(f"{state}/progress/state/0") if p.isdigit()]
    assert len(parts) <= spark.sparkContext.defaultParallelism


def test_terms_of_two_rises_are_worked_out_once_a_shape(monkeypatch):
    t, y = np.arange(40.0), np.random.default_rng(3).exponential(2.0, 40)
    spec = {"lo1": 0.3, "hi1": 90.0, "n1": 24, "lo2": 0.3, "hi2": 90.0, "n2": 24}
    worked, plain = [], np.expm1
    monkeypatch.setattr(np, "expm1", lambda x: worked.append(np.size(x)) or plain(x))
    i, sums = fit._partial_sums(t, y, spec, "two_rises", True)
    assert sum(worked) <= 2 * 24 * len(t)
    shapes = np.exp(np.linspace(np.log(0.3), np.log(90.0), 24))
    assert len(i) == 24 * 23 // 2
    for at, *row in zip(i, *sums):
        a, b = (-plain(-t / shapes[k]) for k in divmod(at, 24))
        np.testing.assert_allclose(row, [y @ y, y @ a, y @ b, 0, a @ a, a @ b, 0, b @ b, 0, 0], rtol=1e-9)


def test_cleaned_points_are_written_before_they_are_numbered(spark, monkeypatch):
    written, plain = [], fit.staged
    monkeypatch.setattr(fit, "staged", lambda df: written.append(df) or plain(df))
    rows = spark.createDataFrame([(1, i, float(i), float(i % 5)) for i in range(40)], "trace_id long, frame long, t double, y double")
    out = fit.fit_points(rows.withColumn("n", F.lit(40).cast("long")), ["trace_id"], "t", "y", n_rows="n")
    assert out.count() == 40
    assert "collect_list" not in written[-1]._jdf.queryExecution().optimizedPlan().toString()
