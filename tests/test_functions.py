"""Column functions against hand-worked values."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from kinsieve.functions import codes, dates, numbers, recoding

D = datetime.date


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_halves_round_to_even(spark):
    got = column(spark, [0.5, 1.5, 2.5, 4.5, -0.5, None, 0.285], "double", lambda x: numbers.round_even(x))
    assert got == [0.0, 2.0, 2.0, 4.0, 0.0, None, 0.0]
    assert column(spark, [0.125, 0.375, 2.675], "double", lambda x: numbers.round_even(x, 2)) == [0.12, 0.38, 2.68]


def test_significant_digits(spark):
    got = column(spark, [23.456, 188.7, 0.0, 0.023456, -1234.0, None, 5.0], "double", lambda x: numbers.signif(x, 2))
    assert got == [23.0, 190.0, 0.0, 0.023, -1200.0, None, 5.0]


def test_uniform_is_reproducible_and_inside_the_unit_interval(spark):
    df = spark.range(2000).select(numbers.uniform(7, F.col("id")).alias("u"), numbers.uniform(8, F.col("id")).alias("w"))
    first, second = df.toPandas(), df.repartition(3).toPandas()
    assert sorted(first["u"]) == sorted(second["u"])
    assert 0 < first["u"].min() and first["u"].max() < 1 and abs(first["u"].mean() - 0.5) < 0.03
    assert abs(first["u"].corr(first["w"])) < 0.08


def test_row_extremes_and_null_count(spark):
    df = spark.createDataFrame([(1, 5, 2), (None, 3, None), (None, None, None)], "a int, b int, c int")
    cols = [F.col(c) for c in "abc"]
    got = df.select(
        numbers.row_max(*cols), numbers.row_min(*cols), numbers.row_max(*cols, skip_nulls=False), numbers.null_count(*cols)
    ).collect()
    assert [tuple(r) for r in got] == [(5, 1, 5, 0), (3, 3, None, 2), (None, None, None, 3)]


def test_bins_state_their_closed_side(spark):
    ends = [float("-inf"), 18.0, float("inf")]
    right = column(spark, [17.9, 18.0, 18.1, None], "double", lambda x: numbers.bin_label(x, ends, ["child", "adult"]))
    left = column(spark, [17.9, 18.0, 18.1, None], "double", lambda x: numbers.bin_label(x, ends, ["child", "adult"], "left"))
    assert right == ["child", "child", "adult", None] and left == ["child", "adult", "adult", None]
    outside = column(spark, [-1.0, 0.0, 45.0], "double", lambda x: numbers.bin_label(x, [-1, 0.5, 44], ["a", "b"]))
    assert outside == [None, "a", None]
    with pytest.raises(ValueError):
        numbers.bin_label(F.lit(1), [0, 1], ["a", "b"])


def test_two_way_choice_propagates_null(spark):
    got = column(spark, [20, 5, None], "int", lambda x: numbers.if_else(x >= 10, F.lit("aggr"), F.lit("indolent")))
    assert got == ["aggr", "indolent", None]


def test_product_is_voided_by_a_null(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", None)], "g string, x double")
    got = dict(df.groupBy("g").agg(numbers.guarded_product(F.col("x"))).collect())
    assert got["a"] == pytest.approx(6.0) and got["b"] is None


def test_codes(spark):
    rows = ["ABC12345PT", "ABC12345FA", "ABC12345S1", "ABC12345S200107", "ABC12345MGM", "ABC12345S209913"]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    got = df.select(
        codes.family_of(F.col("c")), codes.relationship_of(F.col("c")), codes.sibling_birth_date(F.col("c"))
    ).collect()
    assert {r[0] for r in got} == {"ABC12345"}
    assert [r[1] for r in got] == ["PT", "FA", "SI", "SI", "MGM", "SI"]
    assert [r[2] for r in got] == [None, None, None, D(2001, 7, 15), None, None]


def test_code_shape(spark):
    values = ["ABC12345PT", "QX777004PT", "AB12345PT", "ABC1234PT", "XQX777004PT"]
    assert column(spark, values, "string", codes.is_well_formed) == [True, False, False, False, False]
    own = lambda c: codes.is_well_formed(c, "^QX777[0-9]{3}[A-Za-z]")
    assert column(spark, values, "string", own) == [True, True, False, False, False]


def test_long_suffix_is_whole(spark):
    assert column(spark, ["ABC12345" + "x" * 1500], "string", codes.suffix_of) == ["x" * 1500]


def test_codes_of_far_apart_keys_differ(spark):
    from kinsieve.catalog.standins import subject_code

    got = column(spark, [0, 878_800_000, 2**31], "bigint", subject_code)
    assert len(set(got)) == 3 and got[0] == "AAA00000PT"


def test_wells_run_down_the_columns(spark):
    got = column(spark, [1, 8, 9, 95, 96], "int", codes.well_label)
    assert got == ["A1", "H1", "A2", "G12", "H12"]


def test_serial_dates(spark):
    assert column(spark, [1.0, 40000.75, None], "double", dates.from_serial) == [D(1899, 12, 31), D(2009, 7, 6), None]


def test_partial_dates_impute_the_month_only(spark):
    df = spark.createDataFrame([(2001, 4), (2001, None), (None, 4), (2001, 13)], "y int, m int")
    got = [r[0] for r in df.select(dates.partial_date(F.col("y"), F.col("m"))).collect()]
    assert got == [D(2001, 4, 15), D(2001, 6, 15), None, None]


def test_years_and_shifts(spark):
    df = spark.createDataFrame([(D(2010, 1, 1), D(2000, 1, 1), 10.5), (None, D(2000, 1, 1), None)], "a date, b date, y double")
    got = df.select(dates.years_between(F.col("a"), F.col("b")), dates.shift_years(F.col("b"), F.col("y"))).collect()
    assert tuple(got[0]) == (10.0, D(2000, 1, 1) + datetime.timedelta(days=math.floor(10.5 * 365.25)))
    assert tuple(got[1]) == (None, None)


def test_sentinels_match_inside_the_number(spark):
    got = column(spark, [999, 29990, 998, None, 99], "long", lambda x: recoding.without_sentinel(x, "999"))
    assert got == [None, None, 998, None, 99]


def test_recode_and_levels(spark):
    got = column(spark, ["WB", "BUC", "??", None], "string", lambda x: recoding.recode(x, {"WB": 10, "BUC": 3}, 0))
    assert got == [10, 3, 0, 0]
    levels = ["low", "mid", "high"]
    number = column(spark, ["high", "low", "odd", None], "string", lambda x: recoding.level_number(x, levels))
    assert number == [3, 1, None, None]
    # the label of a number does not move when a level is absent from the data
    label = column(spark, [3, 1, None], "int", lambda x: recoding.level_label(x, levels))
    assert label == ["high", "low", None]


def test_search_over_all_columns(spark):
    df = spark.createDataFrame([("carcinoma", 1), (None, 2), ("none", 77)], "a string, b int")
    got = [r[0] for r in df.select(recoding.any_matches([F.col("a"), F.col("b")], "carci|77")).collect()]
    assert got == [True, False, True]
