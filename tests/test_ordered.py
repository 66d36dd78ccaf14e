"""Bucketed ordered analytics against brute force, with hot groups, ties and NULLs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinsieve.operators import ordered as o
from kinsieve.operators.joins import with_average_rank

SIZES = [None, 40, 7]


def rows(n=300, seed=3):
    """A third of the rows sit in one group, a third share one value, some values are missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        value = None if rng.random() < 0.15 else (5.0 if rng.random() < 0.4 else round(rng.uniform(-9, 9), 1))
        out.append((i, group, value, rng.choice(["x", "xy", "y", "é", None])))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "id long, g string, v double, s string").repartition(5)


def pandas_frame():
    return pd.DataFrame(rows(), columns=["id", "g", "v", "s"]).astype({"v": float})


@pytest.mark.parametrize("size", SIZES)
def test_grouped_index_and_total(frame, size):
    got = o.with_index(frame, [o.asc("v"), o.asc("id")], ["g"], "i", "n", size).toPandas()
    want = pandas_frame().sort_values(["v", "id"], na_position="first")
    want["i"] = want.groupby("g", dropna=False).cumcount() + 1
    want["n"] = want.groupby("g", dropna=False)["id"].transform("size")
    assert dict(zip(got["id"], zip(got["i"], got["n"]))) == dict(zip(want["id"], zip(want["i"], want["n"])))


@pytest.mark.parametrize("size", SIZES)
def test_global_index_mixed_directions(frame, size):
    got = o.with_index(frame, [o.desc("s"), o.desc("v"), o.asc("id")], name="i", rows_per_bucket=size)
    got = [r.id for r in got.orderBy("i").collect()]

    def key(r):
        return (
            r[3] is None,
            [-b for b in (r[3] or "").encode()] + [1],
            r[2] is None,
            -(r[2] or 0),
            r[0],
        )

    assert got == [r[0] for r in sorted(rows(), key=key)]


@pytest.mark.parametrize("size", SIZES)
def test_fill_both_ways_within_group(frame, size):
    got = o.fill_missing(frame, ["v", "s"], ["id"], ["g"], both_ways=True, rows_per_bucket=size).toPandas()
    want = pandas_frame().sort_values("id")
    for c in ("v", "s"):
        want[c] = want.groupby("g", dropna=False)[c].transform(lambda x: x.ffill().bfill())
    got = got.sort_values("id").reset_index(drop=True)
    want = want.reset_index(drop=True)
    assert np.allclose(got["v"], want["v"], equal_nan=True)
    assert got["s"].fillna("-").tolist() == want["s"].fillna("-").tolist()


@pytest.mark.parametrize("size", SIZES)
def test_forward_fill_keeps_leading_gap(spark, size):
    df = spark.createDataFrame([(i, None if i % 20 else i) for i in range(1, 200)], "id int, v int")
    got = [r.v for r in o.fill_missing(df, ["v"], ["id"], rows_per_bucket=size).orderBy("id").collect()]
    assert got == [None if i < 20 else i - i % 20 for i in range(1, 200)]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("descending", [False, True])
def test_average_rank(frame, size, descending):
    got = with_average_rank(frame, "v", "r", descending, ["g"], rows_per_bucket=size).toPandas()
    want = pandas_frame()
    want["r"] = want.groupby("g", dropna=False)["v"].rank(ascending=not descending)
    a, b = got.set_index("id")["r"].sort_index(), want.set_index("id")["r"].sort_index()
    assert np.allclose(a, b, equal_nan=True)


def test_average_rank_sum_and_missing_last(frame):
    got = with_average_rank(frame, "v", "r", missing="last").toPandas()
    assert got["r"].sum() == 300 * 301 / 2
    want = pandas_frame()
    want["r"] = want["v"].rank(na_option="bottom")
    assert np.allclose(got.set_index("id")["r"].sort_index(), want.set_index("id")["r"].sort_index())


@pytest.mark.parametrize("refinements", [0, 1, 3])
def test_exact_quantiles(frame, refinements):
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = o.exact_quantiles(frame, "v", probs, names, ["g"], refinements).toPandas()
    known = pandas_frame().dropna(subset=["v"])
    for _, row in got.iterrows():
        x = known[known["g"].isna()] if row["g"] is None else known[known["g"] == row["g"]]
        assert np.allclose(row[names].astype(float), np.quantile(x["v"], probs))


@pytest.mark.parametrize("size", SIZES)
def test_every_kth(frame, size):
    got = {r.id for r in o.every_kth(frame, 10, [o.desc("v"), o.asc("id")], 0.5, size).collect()}
    want = sorted(rows(), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert got == {r[0] for r in want[:150:10]}


def test_step_distribution_is_monotone(frame):
    got = o.step_distribution(frame, "v", rows_per_bucket=9).orderBy("v").toPandas()
    assert got["share"].is_monotonic_increasing and got["share"].iloc[-1] == 1.0
    assert got["n"].sum() == pandas_frame()["v"].notna().sum()


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id long, g string, v double, s string")
    assert o.with_index(empty, ["id"], ["g"]).count() == 0
    assert with_average_rank(empty, "v", "r").count() == 0


def test_buckets_stay_balanced_with_a_hot_group(frame):
    cut = o.OrderedFrame(frame, ["id"], ["g"], 20)
    sizes = [r["count"] for r in cut.frame.groupBy("__bucket").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 90


def test_order_bins_never_fall(spark):
    from kinsieve.operators.quantiles import order_bin

    tiny = 5e-324
    values = [float("-inf"), -1e308, -2.0, -1.0000001, -1.0, -0.5, -1e-300, -tiny, -0.0, 0.0, tiny, 1e-300, 0.1, 0.5, 1.0]
    values += [1.0 + i * 1e-3 for i in range(1, 3000)] + [7.0, 1e15, 1e308, float("inf"), float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", order_bin(o.F.col("v")).alias("b"))
    bins = [r.b for r in rows.orderBy("i").collect()]
    assert bins == sorted(bins) and bins[-1] > bins[-2]


@pytest.mark.parametrize("refinements", [0, 1, 2])
def test_positions_in_a_hot_group_and_odd_values(spark, refinements):
    """A third of all rows in one group, another third tied on one value, groups with few or no values, a missing key."""
    from kinsieve.operators.quantiles import at_positions, quantiles

    rng = np.random.default_rng(8)
    rows = [("hot", float(x)) for x in rng.normal(100, 1e-3, 4000)] + [("tied", 5.0)] * 4000
    rows += [(f"g{i % 900}", float(x)) for i, x in enumerate(rng.standard_cauchy(4000) * 1e6)]
    rows += [(None, 1.0), (None, -1.0), ("none", None), ("hot", None), ("ends", float("inf")), ("ends", float("-inf")), ("ends", 0.0)]
    df = spark.createDataFrame([(g, v, None if v is None else -v) for g, v in rows], "g string, v double, w double").repartition(5)
    every = lambda total: o.F.array(o.F.lit(0), total - 1, o.F.floor(total / 3), total)
    got = at_positions(df, "v", every, ["g"], refinements).collect()
    by_group = {}
    for g, v in rows:
        if v is not None:
            by_group.setdefault(g, []).append(v)
    want = set()
    for g, x in by_group.items():
        x.sort()
        want |= {(g, p, len(x), x[p], sum(y < x[p] for y in x)) for p in (0, len(x) - 1, len(x) // 3)}
    assert {tuple(r) for r in got} == want
    one = at_positions(df, "w", lambda total: o.F.array(o.F.lit(7)), refinements=refinements).collect()
    assert [r.value for r in one] == [sorted(-v for _, v in rows if v is not None)[7]]
    both = quantiles(df.filter("g <> 'ends'"), {"m": ("v", 0.5), "n": ("w", 0.9), "k": ("v", 0.9)}, ["g"], refinements).collect()
    assert len(both) == len(by_group) - 2
    for r in both:
        x = by_group[r.g]
        assert np.allclose([r.m, r.n, r.k], [np.quantile(x, 0.5), -np.quantile(x, 0.1), np.quantile(x, 0.9)])


def test_quantiles_neither_sort_nor_write(frame):
    from kinsieve.operators.quantiles import quantiles

    plan = quantiles(frame, {"m": ("v", 0.5)}, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower() and "rangepartitioning" not in plan
