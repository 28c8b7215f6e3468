"""Alarms and windows on streams whose rows come late, in many batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktraces.operators.events import Settings
from sparktraces.streaming import live

S = Settings(settling=1, baseline=5, lag=2, spike_sigma=3.0)


def by_row(values, s):
    """The alarms with one step per row, as a check of the array form."""
    recent, total, fired, out = [], 0.0, set(), []
    for i, v in enumerate(values):
        if i >= s.warm_up:
            q25, mu, q75 = np.percentile(recent[: s.baseline], [25, 50, 75])
            sigma = max(min((q75 - q25) * live.IQR_TO_SIGMA, s.max_sigma), s.noise_floor)
            dev = v - mu - max(s.min_drift, s.drift_factor * sigma)
            total = total + dev if dev > 0 else 0.0
            for kind, hit in (("drift", total > max(s.min_sum, s.sum_factor * sigma)), ("spike", v - mu > s.spike_sigma * sigma)):
                if hit and kind not in fired:
                    fired.add(kind)
                    out.append((i, kind))
        recent = [*recent, v][-(s.baseline + s.lag):]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_array_steps_match_row_steps(seed):
    rng = np.random.default_rng(seed)
    values = np.cumsum(rng.standard_normal(200) * rng.choice([0.2, 2.0], 200)) if seed % 2 else rng.standard_normal(200)
    want = by_row(values.tolist(), S)
    assert live.advance((0, [], 0.0, []), values, S)[1] == want
    state, got = (0, [], 0.0, []), []
    for part in np.split(values, sorted(rng.integers(0, 200, 12))):
        state, found = live.advance(state, part, S)
        got += found
    assert sorted(got) == want


START = dt.datetime(2024, 1, 1)


def late_rows(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(3):
        values = rng.standard_normal(60)
        values[40 + k:] += 30
        rows += [(k, START + dt.timedelta(minutes=i), float(v)) for i, v in enumerate(values)]
    rows.append((None, START, 1.0))
    return spark.createDataFrame(rows, "k int, at timestamp, y double").withColumn("delay", F.pmod(F.xxhash64("at", "k"), F.lit(1800)))


def test_late_rows_count_in_time_order(spark):
    rows = late_rows(spark)
    stream, close = live.closing(live.replayed(rows, F.unix_seconds("at") + F.col("delay"), 5), "at")
    got = live.drain(live.online_alarms(stream, "k", "at", "y", settings=S, late="30 minutes"), "late", close=close).collect()
    want = []
    for k in range(3):
        values = [r["y"] for r in rows.filter(F.col("k") == k).orderBy("at").collect()]
        want += [(k, i, kind) for i, kind in by_row(values, S)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) >= 3


def test_sessions_merge_over_batches_and_close(spark):
    minutes = [0, 5, 40, 8, 12, 70, 44, 75]
    rows = spark.createDataFrame([(1, START + dt.timedelta(minutes=m), float(m)) for m in minutes], "k int, at timestamp, y double")
    place = F.array_position(F.array(*[F.lit(float(m)) for m in minutes]), F.col("y"))
    stream, close = live.closing(live.replayed(rows, place, 4), "at")
    out = live.session_summary(stream, ["k"], "at", "y", gap="10 minutes", late="2 hours")
    got = live.before_end(live.drain(out, "sessions", close=close)).orderBy("window.start").collect()
    assert [(r["n"], r["peak"]) for r in got] == [(4, 12.0), (2, 44.0), (2, 75.0)]
