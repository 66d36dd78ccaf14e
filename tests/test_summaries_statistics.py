"""Counts, distributions, regressions and tests against closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.functions import tails
from plain_tails import f_upper, range_upper, t_critical, t_two_sided
from kinsieve.operators import statistics, summaries
from kinsieve.operators.ordered import asc
from kinsieve.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        x = rng.uniform(0, 10)
        t = rng.choice(["BUC", "MW", "WB"])
        rows.append((i, x, 3 + 2 * x + (4 if t == "MW" else 0) + rng.gauss(0, 1), t, None if i % 9 == 0 else x > 5))
    return spark.createDataFrame(rows, "id int, x double, y double, t string, s boolean")


def test_shares_use_the_stated_total(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert {r.k: r.share for r in summaries.shares_by(df, "k").collect()} == {"a": 0.5, "b": 0.25, None: 0.25}
    part = df.filter("k = 'a'")
    assert [r.share for r in summaries.shares_by(part, "k", total=df).collect()] == [0.5]


def test_cumulative_share_of_a_subset_over_the_whole(spark):
    df = spark.createDataFrame([(0, 10), (0, 50), (1, 10), (2, 10)], "missed int, conc int")
    out = summaries.cumulative_shares(df.filter("conc < 36"), "missed", [asc("missed")], total=df)
    assert {r.missed: r.cumulative for r in out.collect()} == {0: 0.25, 1: 0.5, 2: 0.75}


def test_summary_of_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5), (4.0, 5), (None, 7)], "a double, b int")
    got = {r.column_name: r for r in summaries.column_summary(df, ["a", "b"]).collect()}
    assert (got["a"].min, got["a"].q1, got["a"].median, got["a"].q3, got["a"].max, got["a"].missing) == (1, 1.5, 2, 3, 4, 1)
    assert got["b"].mean == pytest.approx(17 / 3) and got["b"].missing == 1
    forced = {r.column_name: r for r in summaries.column_summary(df, ["a", "b"], refinements=3).collect()}
    assert forced == got


def test_distribution_at_points_is_monotone(points):
    got = summaries.shares_at_or_below(points, {"x": "x", "y": "y"}, [0, 2, 5, 10]).orderBy("point").collect()
    assert [r.x for r in got] == sorted(r.x for r in got) and got[0].x == 0 and got[-1].x == 1


def test_histograms(spark):
    df = spark.createDataFrame([(float(v), f) for v, f in [(0, "a"), (4.9, "a"), (5, "a"), (10, "b"), (10, "b")]], "v double, f string")
    assert {r.bin_start: r.n for r in summaries.histogram_by_width(df, "v", 5.0).collect()} == {0.0: 2, 5.0: 1, 10.0: 2}
    # the lowest value joins the first right-closed bin
    assert {r.bin: r.n for r in summaries.histogram_by_count(df, "v", 2).collect()} == {1: 3, 2: 2}
    dens = summaries.histogram_by_width(df, "v", 5.0, ["f"], density=True).collect()
    assert {(r.f, r.bin_start): r.density for r in dens} == {("a", 0.0): 2 / 15, ("a", 5.0): 1 / 15, ("b", 10.0): 1 / 5}
    plain = summaries.histogram_by_width(df, "v", 5.0, density=True).collect()
    assert sum(r.density * 5 for r in plain) == pytest.approx(1)


def test_box_whiskers_stop_at_data(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, v double")
    r = summaries.box_stats(df, "v", ["g"]).collect()[0]
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2.25, 3.5, 4.75, 1, 5, 1)


def test_flags_margins_and_agreement(spark):
    df = spark.createDataFrame([(True, None), (False, True), (True, True), (None, False)], "a boolean, b boolean")
    got = {r.measure: (r.a, r.b) for r in summaries.flag_totals(df, ["a", "b"]).collect()}
    assert got == {"count": (2.0, 2.0), "share": (0.5, 0.5)}
    same = {r.same: r.n for r in summaries.agreement(df, "a", "b").collect()}
    assert same == {None: 2, False: 1, True: 1}


def test_z_score_uses_the_sample_deviation(points):
    got = summaries.z_score(points, "x", "z").toPandas()
    assert np.allclose(got["z"], (got["x"] - got["x"].mean()) / got["x"].std(ddof=1))


def test_means_with_interval(points):
    pdf = points.toPandas()
    for r in summaries.group_means_interval(points, "y", ["t"]).collect():
        y = pdf[pdf.t == r.t]["y"]
        half = t_critical(0.95, len(y) - 1) * y.std(ddof=1) / math.sqrt(len(y))
        assert (r.n, r.mean, r.low, r.high) == (len(y), pytest.approx(y.mean()), pytest.approx(y.mean() - half), pytest.approx(y.mean() + half))


def test_plain_tail_areas():
    # published table values
    assert t_critical(0.95, 1) == pytest.approx(12.7062, abs=1e-4)
    assert t_critical(0.95, 10) == pytest.approx(2.22814, abs=1e-5)
    assert t_critical(0.95, 1000) == pytest.approx(1.96234, abs=1e-5)
    assert f_upper(4.10282, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert range_upper(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert range_upper(4.327, 4, 10) == pytest.approx(0.05, abs=2e-4)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_f_and_t_tails_agree_with_the_continued_fraction(spark):
    rows = [(f, a, b) for f in (1e-6, 0.3, 0.99, 1.0, 1.02, 4.1, 60.0) for a in (1.0, 2.0, 7.5, 400.0) for b in (1.0, 3.0, 30.0, 5000.0)]
    df = spark.createDataFrame(rows, "f double, a double, b double")
    got = df.select("*", tails.f_p_value(F.col("f"), F.col("a"), F.col("b")).alias("p"), tails.t_p_value(-F.col("f"), F.col("b")).alias("t"))
    for r in got.collect():
        assert r.p == pytest.approx(f_upper(r.f, r.a, r.b), rel=1e-8, abs=1e-12), r
        assert r.t == pytest.approx(t_two_sided(r.f, r.b), rel=1e-8, abs=1e-12), r


def test_f_tail_with_very_many_degrees(spark):
    # two degrees above have a closed form, and so many below that t is normal
    df = spark.createDataFrame([(x, b) for x in (0.5, 1.0, 3.0) for b in (1e3, 1e6, 1e9)], "x double, b double")
    for r in df.select("*", tails.f_p_value(F.col("x"), F.lit(2.0), F.col("b")).alias("f"), tails.t_p_value(F.col("x"), F.col("b")).alias("t")).collect():
        assert r.f == pytest.approx(math.exp(-r.b / 2 * math.log1p(2 * r.x / r.b)), rel=1e-7)
        if r.b > 1e8:
            assert r.t == pytest.approx(math.erfc(r.x / math.sqrt(2)), rel=1e-6)


def test_tails_without_degrees_or_values(spark):
    df = spark.createDataFrame([(None, 3.0), (2.0, None), (2.0, 0.0), (0.0, 3.0)], "x double, b double")
    x, b = F.col("x"), F.col("b")
    got = df.select(tails.f_p_value(x, F.lit(1.0), b), tails.t_p_value(x, b), tails.range_p_value(x, F.lit(3), b)).collect()
    assert [tuple(r) for r in got[:3]] == [(None, None, None)] * 3
    assert tuple(got[3]) == (1.0, 1.0, pytest.approx(1.0))


def test_t_quantile_agrees_with_bisection(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 10.0, 333.0, 100000.0)] + [(0.0,)], "b double")
    for level in (0.5, 0.95, 0.999):
        for r in df.select("b", tails.t_quantile(level, F.col("b")).alias("t")).collect():
            want = t_critical(level, r.b) if r.b else None
            assert r.t == (want if want is None else pytest.approx(want, rel=1e-7)), (level, r)


def test_normal_and_studentised_range(spark):
    df = spark.range(-380, 381).select((F.col("id") / 47.0).alias("x"))
    for r in df.select("x", tails.normal_below(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-11 if r.x > -7 else 1, abs=2e-12)
    rows = [(q, k, b) for q in (0.2, 3.877, 9.0) for k in (2, 3, 12) for b in (1.0, 10.0, 2500.0)]
    df = spark.createDataFrame(rows, "q double, k int, b double")
    for r in df.select("*", tails.range_p_value(F.col("q"), F.col("k"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx(range_upper(r.q, r.k, r.b), abs=2e-4 if r.b < 2 else 1e-8), r


def test_simple_regression(points):
    pdf = points.toPandas()
    r = statistics.simple_regression(points, F.col("y"), F.col("x"), p_values=True).collect()[0]
    design = np.column_stack([np.ones(len(pdf)), pdf["x"]])
    beta, rss, *_ = np.linalg.lstsq(design, pdf["y"], rcond=None)
    cov = np.linalg.inv(design.T @ design) * rss[0] / (len(pdf) - 2)
    assert (r.intercept, r.slope) == (pytest.approx(beta[0]), pytest.approx(beta[1]))
    assert (r.se_intercept, r.se_slope) == (pytest.approx(cov[0, 0] ** 0.5), pytest.approx(cov[1, 1] ** 0.5))
    assert r.p_slope < 1e-10


def test_regression_with_category_and_interaction(points):
    got = {r.term: r for r in statistics.model_regression(points, "y", ["x", "t"], [("x", "t")]).collect()}
    pdf = points.toPandas()
    mw, wb = (pdf["t"] == "MW").astype(float), (pdf["t"] == "WB").astype(float)
    names = ["(Intercept)", "x", "t[MW]", "t[WB]", "x:t[MW]", "x:t[WB]"]
    assert set(got) == set(names)
    design = np.column_stack([np.ones(len(pdf)), pdf["x"], mw, wb, pdf["x"] * mw, pdf["x"] * wb])
    beta, rss, *_ = np.linalg.lstsq(design, pdf["y"], rcond=None)
    cov = np.linalg.inv(design.T @ design) * rss[0] / (len(pdf) - len(names))
    for i, name in enumerate(names):
        assert got[name].estimate == pytest.approx(beta[i], rel=1e-6)
        assert got[name].se == pytest.approx(cov[i, i] ** 0.5, rel=1e-6)
    assert got["x"].p < 1e-10 and 0 <= got["x:t[WB]"].p <= 1


def test_welch(points):
    pdf = points.toPandas().dropna(subset=["s"])
    a, b = pdf[pdf.s == False]["y"], pdf[pdf.s == True]["y"]  # noqa: E712
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    r = statistics.welch_test(points, F.col("y"), F.col("s"), p_values=True).collect()[0]
    assert r.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
    assert r.df == pytest.approx((va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))
    assert (r.n_false, r.n_true) == (len(a), len(b)) and 0 <= r.p < 1e-6


def test_anova_and_pairs(points):
    pdf = points.toPandas()
    groups = {k: g["y"] for k, g in pdf.groupby("t")}
    grand = pdf["y"].mean()
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups.values())
    within = sum(((g - g.mean()) ** 2).sum() for g in groups.values())
    r = statistics.one_way_anova(points, F.col("y"), F.col("t"), p_values=True).collect()[0]
    f = (between / 2) / (within / (len(pdf) - 3))
    assert (r.df_between, r.df_within) == (2, len(pdf) - 3)
    assert r.f == pytest.approx(f) and 0 <= r.p <= 1
    pairs = statistics.honest_differences(points, F.col("y"), F.col("t"), p_values=True).collect()
    assert {(p.level_a, p.level_b) for p in pairs} == {("BUC", "MW"), ("BUC", "WB"), ("MW", "WB")}
    for p in pairs:
        a, b = groups[p.level_a], groups[p.level_b]
        error = math.sqrt(within / (len(pdf) - 3) / 2 * (1 / len(a) + 1 / len(b)))
        assert p.difference == pytest.approx(b.mean() - a.mean())
        assert p.q == pytest.approx(abs(b.mean() - a.mean()) / error) and 0 <= p.p <= 1


def test_quantiles_do_not_shuffle_the_values(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keys in ([], ["k"]):
            out = quantiles(rows, {"m": ("v", 0.5)}, keys)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert sorted(r.m for r in out.collect()) == ([499.0, 499.5, 500.0] if keys else [499.5])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
