"""Joins with hot keys, update by lookup, first rows, ordered rules, corrections."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinsieve.functions import codes
from kinsieve.operators import joins
from kinsieve.operators.ordered import asc, desc
from kinsieve.operators.rules import Rule, apply_corrections, apply_rules

D = datetime.date


@pytest.fixture(scope="module")
def sides(spark):
    left = [(i, None if i % 10 == 0 else ("hot" if i % 3 == 0 else f"k{i % 40}")) for i in range(600)]
    right = [("hot", 1), ("hot", 2), (None, 9)] + [(f"k{i}", i) for i in range(0, 60, 2)]
    return (
        spark.createDataFrame(left, "id int, k string"),
        spark.createDataFrame(right, "k string, v int"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [None, [], ["hot"], ["hot", "k2", "absent"]])
def test_salted_join_equals_plain_join(sides, how, hot):
    left, right = sides
    got = joins.salted_join(left, right, ["k"], how, hot)
    want = left.join(right, "k", how)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [[], ["hot"]])
def test_null_safe_salted_join(sides, how, hot):
    left, right = sides
    got = joins.salted_join(left, right, ["k"], how, hot, null_safe=True)
    other = right.withColumnRenamed("k", "k2")
    want = left.join(other, F.col("k").eqNullSafe(F.col("k2")), how).drop("k2")
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))


def test_equal_rows_of_a_known_hot_key_use_all_salts(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("k"))
    joined = joins.salted_join(rows, spark.createDataFrame([("hot", 1)], "k string, v int"), ["k"], hot=["hot"])
    assert joined.count() == 1_000_000
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_salt = rows.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(salts))).count()
    counts = [r[1] for r in per_salt.collect()]
    assert len(counts) == salts and max(counts) < 1.5 * min(counts)


def test_hot_partition_is_split_at_run_time(spark):
    """A hot key that nobody named: the join's partition is split while the query runs."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        # the rows come from several map tasks, by which the partition is split
        left = spark.range(0, 400_000, 1, 8).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
        joined = joins.salted_join(left, spark.range(1_000).withColumnRenamed("id", "k"), ["k"])
        assert joined.count() > 200_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)



def test_salted_join_refuses_other_kinds(sides):
    with pytest.raises(ValueError):
        joins.salted_join(*sides, ["k"], "full")


def test_lookup_update_rules(spark):
    df = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old"), (None, "old")], "k int, v string")
    lookup = spark.createDataFrame([(1, "new", 1), (2, None, 1), (1, "newer", 2), (9, "x", 1)], "k int, w string, o int")
    got = joins.lookup_update(df, lookup, ["k"], {"v": "w", "extra": "w"}, [asc("o")])
    got = {r.k: (r.v, r.extra) for r in got.collect()}
    # a matched NULL overwrites, an unmatched row keeps its value, the last lookup row wins
    assert got == {1: ("newer", "newer"), 2: (None, None), 3: ("old", None), None: ("old", None)}


def test_constant_update(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "k int, v string")
    got = [r.v for r in joins.constant_update(df, "k", [1, 2], "v", "done").orderBy("k").collect()]
    assert got == ["c", "done", "done"]


def test_first_row_per_person_takes_missing_dates_first(spark):
    rows = [("p", D(2000, 1, 2), 5), ("p", None, 9), ("p", None, 3), ("q", D(2001, 1, 1), 2), ("q", D(2001, 1, 1), 1)]
    df = spark.createDataFrame(rows, "p string, d date, s int")
    got = {r.p: (r.d, r.s) for r in joins.first_per_key(df, ["p"], [asc("d"), asc("s")]).collect()}
    assert got == {"p": (None, 3), "q": (D(2001, 1, 1), 1)}
    last = {r.p: r.s for r in joins.first_per_key(df, ["p"], [desc("d"), desc("s")]).collect()}
    assert last == {"p": 5, "q": 2}


def test_sibling_takes_the_patients_class_of_its_own_family(spark):
    rows = [
        ("AAA00001PT", "child"), ("AAA00001S1", None), ("AAA00001S2", "adult"), ("AAA00001FA", None),
        ("BBB00002PT", "adult"), ("BBB00002S1", None), ("CCC00003S1", None),
    ]
    df = spark.createDataFrame(rows, "c string, cls string").withColumn("fam", codes.family_of(F.col("c")))
    suffix = codes.suffix_of(F.col("c"))
    out = joins.inherit_from_relative(df, "fam", ["cls"], suffix == "PT", suffix.startswith("S"), [asc("c")])
    got = {r.c: r.cls for r in out.collect()}
    assert got["AAA00001S1"] == "child" and got["AAA00001S2"] == "adult" and got["AAA00001FA"] is None
    assert got["BBB00002S1"] == "adult" and got["CCC00003S1"] is None


def test_average_rank_joins_back(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(70)], "id int, v double")
    got = joins.with_average_rank(df, "v", "r").toPandas()
    want = got["v"].rank()
    assert (got["r"].fillna(-1) == want.fillna(-1)).all()


def test_rules_run_in_order_and_null_conditions_select_nothing(spark):
    df = spark.createDataFrame([("WB", 1), ("MW", None), (None, 3)], "t string, n int")
    out = apply_rules(
        df,
        [
            Rule("flag", F.col("n") >= 1, "clear"),
            Rule("flag", F.col("n") >= 3, "involved"),
            Rule("t", F.col("t") == "WB", "XX"),
            Rule("t", F.col("t") == "XX", "YY"),
        ],
    )
    got = {r.n: (r.t, r.flag) for r in out.collect()}
    assert got == {1: ("YY", "clear"), None: ("MW", None), 3: (None, "involved")}


def test_corrections_table(spark):
    df = spark.createDataFrame([(1, "WB", 10), (2, "MW", 20), (3, "MW", 30)], "id int, tissue string, stock int")
    fixes = spark.createDataFrame(
        [(1, "tissue", "LRNXP", 1), (1, "tissue", "BUC", 2), (1, "stock", "11", 1), (2, "stock", None, 1), (8, "stock", "1", 1)],
        "id int, column_name string, new_value string, at int",
    )
    got = {r.id: (r.tissue, r.stock) for r in apply_corrections(df, fixes, "id", ["tissue", "stock"], [asc("at")]).collect()}
    assert got == {1: ("BUC", 11), 2: ("MW", None), 3: ("MW", 30)}
