"""The ordered core against plain pandas, with small chunks so that every chunk border is exercised."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktraces.operators import smoothing
from sparktraces.operators.quantiles import quantiles
from sparktraces.operators import ensembles, stats
from sparktraces.operators.ranks import average_ranks, rank_table, ranged, two_sample_ranks
from sparktraces.operators.sequence import number_rows, renumber, rolling, running_sum, with_summary
from sparktraces.plans.bindings import traces

SMALL = 7


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    df = traces(spark, sf_dir).select("trace_id", "event_id", "frame", "n_rows", "t", "y")
    df = df.cache()
    yield df
    df.unpersist()


def by_trace(df):
    return df.toPandas().sort_values(["trace_id", "frame"]).reset_index(drop=True)


def test_frames_are_dense_for_any_bucket_size(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.col("event_id") * 3)
    got = number_rows(events, ["user_id"], ["event_id"], "k", n_rows="n", bucket_rows=10).toPandas()
    got = got.sort_values(["user_id", "event_id"])
    assert (got.groupby("user_id").cumcount() == got.frame).all()
    assert (got.groupby("user_id").user_id.transform("size") == got.n).all()


def test_one_hot_trace_spreads_over_buckets(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("at"))
    got = number_rows(df, ["k"], ["at"], "at", bucket_rows=100).toPandas().sort_values(["k", "at"])
    assert (got.groupby("k").cumcount() == got.frame).all()


def test_running_sum_with_resets(rows):
    got = by_trace(running_sum(rows, ["trace_id"], F.col("y"), reset=F.col("y") < 10, chunk_rows=SMALL))
    for _, g in got.groupby("trace_id"):
        total, want = 0.0, []
        for v in g.y:
            total = 0.0 if v < 10 else total + v
            want.append(total)
        assert np.allclose(want, g.running)


def test_renumber_after_filter(rows):
    got = by_trace(renumber(rows.filter("y > 20"), ["trace_id"], n_rows="kept", chunk_rows=SMALL))
    assert (got.groupby("trace_id").cumcount() == got.frame).all()
    assert (got.groupby("trace_id").frame.transform("size") == got.kept).all()


def test_rolling_crosses_chunks(rows):
    got = by_trace(
        rolling(
            rows, ["trace_id"], {"m": lambda w: F.expr("percentile(y, 0.5)").over(w.rowsBetween(-2, 2))},
            before=2, after=2, chunk_rows=SMALL,
        )
    )
    want = got.groupby("trace_id").y.rolling(5, center=True, min_periods=1).median().values
    assert len(got) == rows.count() and np.allclose(got.m, want)


def test_summary_reaches_every_row(rows):
    got = by_trace(with_summary(rows, ["trace_id"], F.max("y").alias("top"), chunk_rows=SMALL))
    assert np.allclose(got.top, got.groupby("trace_id").y.transform("max"))


def test_outliers_match_padded_medians(rows):
    got = by_trace(smoothing.outlier_free(rows, ["trace_id"], "y", n_rows="n_rows"))

    def median11(v):
        p = np.pad(v, 5, mode="edge")
        return np.array([np.median(p[i : i + 11]) for i in range(len(v))])

    for _, g in got.groupby("trace_id"):
        v = g.y.to_numpy()
        dev = abs(v - median11(v))
        keep = np.ones(len(v), bool) if len(v) < 11 else dev <= 2.5 * np.maximum(median11(dev) * 1.4826, 0.1)
        assert (keep == g.inlier).all()


@pytest.mark.parametrize("rows", [50, 100_000])
def test_quantiles_are_exact(spark, sf_dir, rows):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    got = quantiles(df, ["l_returnflag"], "l_extendedprice", {"a": 0.01, "b": 0.5, "c": 0.999}, ordered_rows=rows)
    want = df.toPandas().groupby("l_returnflag").l_extendedprice.quantile([0.01, 0.5, 0.999]).unstack()
    assert np.allclose(got.toPandas().set_index("l_returnflag").sort_index(), want.sort_index())


def test_quantiles_of_ties(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = quantiles(df, ["g"], "v", {"q": 0.25, "m": 0.5}, ordered_rows=40).toPandas()
    want = df.toPandas().v.quantile([0.25, 0.5])
    assert np.allclose(got[["q", "m"]].iloc[0], want)


def test_quantiles_of_heavy_tails(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate((np.exp(rng.standard_normal(3000) * 8), [-1e300, 1e300, 5e-324], np.full(500, 2.5)))
    groups = ["a"] * 3000 + ["b"] * (len(values) - 3000)
    pdf = pd.DataFrame({"g": groups, "v": rng.permutation(values)})
    got = quantiles(spark.createDataFrame(pdf), ["g"], "v", {"lo": 0.0, "q": 0.25, "m": 0.5, "hi": 1.0}, count="n", ordered_rows=60).toPandas().set_index("g")
    for g, rows in pdf.groupby("g"):
        assert got.loc[g, "n"] == len(rows)
        assert np.allclose(got.loc[g, ["lo", "q", "m", "hi"]].astype(float), rows.v.quantile([0, 0.25, 0.5, 1]), rtol=1e-9)


def test_one_extreme_value_leaves_the_buckets_even(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate((rng.random(4000), [1e12, -1e12]))
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": values})).repartition(4)
    placed = ranged(df, ["g", "v"], len(values), bucket_rows=400)
    sizes = placed.groupBy("_bucket").count().toPandas()["count"]
    assert sizes.max() < 2.5 * len(values) / len(sizes)
    bounds = placed.groupBy("_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).toPandas().sort_values("_bucket")
    assert (bounds.lo.to_numpy()[1:] > bounds.hi.to_numpy()[:-1]).all()
    got = rank_table(df, ["g"], "v", bucket_rows=400).toPandas().sort_values("v")
    assert np.allclose(got["rank"], pd.Series(values).sort_values().rank()) and (got.n == len(values)).all()


def test_ranks_of_many_groups_over_buckets(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.choice([1, 2, 2, 2, 2, 2], 3000), "v": np.round(np.exp(3 * rng.standard_normal(3000)), 1)})
    got = average_ranks(spark.createDataFrame(pdf), ["g"], "v").toPandas()
    many = rank_table(spark.createDataFrame(pdf), ["g"], "v", bucket_rows=100).toPandas().set_index(["g", "v"])
    pdf["rank"] = pdf.groupby("g").v.rank()
    want = pdf.drop_duplicates(["g", "v"]).set_index(["g", "v"])["rank"]
    assert np.allclose(many["rank"].sort_index(), want.sort_index())
    assert np.allclose(got.drop_duplicates(["g", "v"]).set_index(["g", "v"])["rank"].sort_index(), want.sort_index())


def test_ranks_and_delta_match_pairs(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"arm": rng.choice(["a", "b"], 400), "v": rng.integers(0, 40, 400).astype(float), "p": 1})
    df = spark.createDataFrame(pdf)
    ranked = average_ranks(df, ["p"], "v").toPandas().sort_values("v")
    assert np.allclose(ranked["rank"], ranked.v.rank())
    got = two_sample_ranks(df, ["p"], "arm", "v", "a", "b").toPandas().iloc[0]
    a, b = pdf.v[pdf.arm == "a"].to_numpy(), pdf.v[pdf.arm == "b"].to_numpy()
    signs = np.sign(a[:, None] - b[None, :])
    assert np.isclose(got.cliffs_delta, signs.mean())
    assert np.isclose(got.u, (signs > 0).sum() + 0.5 * (signs == 0).sum())


def test_matrix_ranks_only_complete_pairs(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(np.round(rng.standard_normal((300, 4)) * 3), columns=list("abcd"))
    pdf["g"] = rng.choice(["u", "v"], 300)
    pdf.loc[rng.random(300) < 0.2, "b"] = np.nan
    pdf.loc[pdf.b.isna() | (rng.random(300) < 0.1), "c"] = np.nan
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, g string")
    got = stats.spearman_matrix(rows, list("abcd"), ["g"]).toPandas().set_index(["g", "x_name", "y_name"])
    for g, part in pdf.groupby("g"):
        for i, x in enumerate("abcd"):
            for y in "abcd"[i:]:
                both = part[[x, y]].dropna() if x != y else part[[x]].dropna()
                want = both[x].rank().corr(both[y].rank())
                assert got.loc[(g, x, y), "n"] == len(both) and np.isclose(got.loc[(g, x, y), "rho"], want)


def test_matrix_of_long_rank_tables_does_not_gather_ties_or_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "BROADCAST_ROWS", 30)
    monkeypatch.setattr(stats, "BUCKET_ROWS", 40)
    monkeypatch.setattr(stats, "RANKED_ROWS", 100)
    rng = np.random.default_rng(9)
    n = 2_000
    pdf = pd.DataFrame({"a": np.round(rng.standard_normal(n) * 50), "b": rng.integers(0, 4, n).astype(float), "c": rng.standard_normal(n)})
    # a third of all rows ties, a third misses the value; zeros of both signs and values that are no numbers tie
    pdf.loc[: n // 3, "a"] = 0.0
    pdf.loc[: n // 6, "a"] = -0.0
    pdf["g"] = rng.choice(["u", "v"], n)
    values = pdf.astype(object)
    values.loc[n // 3 : 2 * n // 3, "c"] = None
    values.loc[values.index[-5:], "g"] = None
    rows = spark.createDataFrame(values[["a", "b", "c", "g"]], "a double, b double, c double, g string")
    seen = []
    joined = stats._with_ranks

    def watched(rows, groups, *rest):
        wide = joined(rows, groups, *rest)
        seen.append([r["n"] for r in wide.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()])
        return wide

    monkeypatch.setattr(stats, "_with_ranks", watched)
    got = stats.spearman_matrix(rows, list("abc"), ["g"]).toPandas().set_index(["g", "x_name", "y_name"])
    assert sorted(set(got.index.get_level_values("g"))) == ["u", "v"]
    pdf = pdf[:-5]
    pdf["c"] = values["c"][:-5].astype(float)
    for g, part in pdf.groupby("g"):
        for i, x in enumerate("abc"):
            for y in "abc"[i:]:
                both = part[[x, y]].dropna() if x != y else part[[x]].dropna()
                assert got.loc[(g, x, y), "n"] == len(both)
                assert np.isclose(got.loc[(g, x, y), "rho"], both[x].rank().corr(both[y].rank()))
    assert max(seen[0]) < 0.2 * n


def test_levels_merge_to_the_same_moments(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame([(k, f"a{k % 2}", f"b{k % 3}", i, float(i), rng.standard_normal() + 100) for k in range(12) for i in range(5) if k != 4 or i < 2], columns=["k", "a", "b", "i", "grid", "value"])
    got = ensembles.level_ensembles(spark.createDataFrame(pdf), ["k"], ["a", "b"], [[], ["a"], ["a", "b"]], share=0.0).toPandas()
    for level in ([], ["a"], ["a", "b"]):
        for key, part in pdf.groupby([*level, "i"]):
            key = dict(zip([*level, "i"], key))
            row = got[(got.a == key.get("a", "*")) & (got.b == key.get("b", "*")) & (got.i == key["i"])]
            assert len(row) == 1 and row.n.iloc[0] == len(part)
            assert np.isclose(row["mean"].iloc[0], part.value.mean()) and np.isclose(row.sd.iloc[0], part.value.std(ddof=0), atol=1e-7)
    assert set(got[(got.a == "*")].traces) == {12}
