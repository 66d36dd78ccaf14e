"""Samples, set operations, reshaping, string aggregation."""

import pytest
from pyspark.sql import functions as F

from kinsieve.operators import reshape, sampling, schema


@pytest.fixture(scope="module")
def items(spark):
    return spark.range(200).select("id", (F.col("id") % 5).cast("double").alias("w"))


def test_simple_sample(items):
    got = [r.id for r in sampling.sample_n(items, 30, ["id"], 1).collect()]
    again = [r.id for r in sampling.sample_n(items.repartition(7), 30, ["id"], 1).collect()]
    assert len(set(got)) == 30 and sorted(got) == sorted(again)
    assert sorted(r.id for r in sampling.sample_n(items, 30, ["id"], 2).collect()) != sorted(got)
    assert sampling.sample_n(items, 0, ["id"], 1).count() == 0
    assert sampling.sample_n(items, 1000, ["id"], 1).count() == 200


def test_weighted_sample_leaves_out_weightless_rows(items):
    got = sampling.weighted_sample_n(items, 500, F.when(F.col("id") != 7, F.col("w")), ["id"], 3).collect()
    assert len(got) == 159 and all(r.w > 0 and r.id != 7 for r in got)
    assert sampling.weighted_sample_n(items, 0, F.col("w"), ["id"], 3).count() == 0


def test_log_weights_draw_the_same_rows(items):
    plain = {r.id for r in sampling.weighted_sample_n(items, 20, F.col("w"), ["id"], 5).collect()}
    logs = F.when(F.col("w") > 0, F.ln("w"))
    assert plain == {r.id for r in sampling.weighted_sample_n(items, 20, logs, ["id"], 5, log_weight=True).collect()}


def test_weighted_sample_follows_the_weights(spark):
    """First of two draws from weights 1:2:7 over many seeds, evaluated as one frame."""
    from kinsieve.functions.numbers import uniform

    seeds = spark.range(4000).withColumnRenamed("id", "seed")
    rows = seeds.select("seed", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in (("a", 1.0), ("b", 2.0), ("c", 7.0))])).alias("r"))
    keyed = rows.select("seed", "r.n", (-F.log(uniform(1, F.col("seed"), F.col("r.n"))) / F.col("r.w")).alias("e"))
    first = keyed.groupBy("seed").agg(F.min_by("n", "e").alias("n")).groupBy("n").count()
    share = {r.n: r["count"] / 4000 for r in first.collect()}
    assert share["a"] == pytest.approx(0.1, abs=0.02) and share["b"] == pytest.approx(0.2, abs=0.025)


def test_random_integer_range(spark):
    got = spark.range(5000).select(sampling.random_integer(96, 4, F.col("id")).alias("h")).agg(F.min("h"), F.max("h")).collect()[0]
    assert tuple(got) == (1, 96)


def test_pivot_undoes_unpivot(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.3, None)], "id int, a double, b double")
    long = reshape.unpivot_long(df, ["id"], ["a", "b"])
    assert long.count() == 4
    wide = reshape.pivot_wide(long, ["id"], "variable", ["a", "b"], F.first("value"))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, df.collect()))


def test_wide_over_found_names(spark):
    df = spark.createDataFrame([(1, "b", 0.1), (1, "a", 0.2), (2, "b", 0.3), (2, "b", 0.4), (3, None, 0.5)], "id int, name string, v double")
    wide = reshape.pivot_wide(df.filter("name is not null"), ["id"], "name", None, F.max("v"))
    assert wide.columns == ["id", "a", "b"]
    assert sorted(map(tuple, wide.collect())) == [(1, 0.2, 0.1), (2, None, 0.4)]


def test_paired_columns_to_rows(spark):
    df = spark.createDataFrame([("x", "work", "a@x", "old home", None)], "n string, k1 string, m1 string, k2 string, m2 string")
    got = reshape.unpivot_groups(df, ["n"], {"kind": ["k1", "k2"], "mail": ["m1", "m2"]}).collect()
    assert [tuple(r) for r in got] == [("x", 1, "work", "a@x"), ("x", 2, "old home", None)]
    with pytest.raises(ValueError):
        reshape.unpivot_groups(df, ["n"], {"kind": ["k1"], "mail": ["m1", "m2"]})


def test_string_aggregation_keeps_repeats_in_order(spark):
    df = spark.createDataFrame([("f", "PT"), ("f", "FA"), ("f", "SI"), ("f", "SI"), ("g", None), ("h", None), ("h", "a")], "g string, r string")
    got = dict(reshape.string_agg(df, ["g"], "r", "s").collect())
    assert got == {"f": "FA, PT, SI, SI", "g": None, "h": "a"}


@pytest.mark.parametrize(("most", "separator"), [(7, ", "), (40, ","), (1 << 20, ", "), (9, "")])
def test_string_aggregation_in_chunks_is_the_cell(spark, most, separator):
    # one group with most of the rows, an item with very many copies, items longer than a chunk, groups without items
    rows = [("hot", f"i{i % 90:03d}") for i in range(400)] + [("hot", "again")] * 500 + [("hot", "much longer than a chunk")] * 3
    rows += [("b", "x"), ("b", None), ("c", None), (None, "n"), (None, "n")]
    df = spark.createDataFrame(rows, "g string, r string").repartition(5)
    want = {r.g: r.s for r in reshape.string_agg(df, ["g"], "r", "s", separator).collect() if r.s is not None}
    chunks = reshape.string_agg_chunks(df, ["g"], "r", "s", separator, most, rows_per_bucket=20).collect()
    got = {}
    for r in sorted(chunks, key=lambda r: r.chunk):
        got.setdefault(r.g, []).append(r.s)
        assert len(r.s) <= most + 24
    assert {g: separator.join(parts) for g, parts in got.items()} == want
    assert most > 1000 or len(got["hot"]) > 50


def test_unions_and_coverage(spark):
    a = spark.createDataFrame([(1, "x")], "id int, p string")
    b = spark.createDataFrame([(2, 5)], "id int, q int")
    assert sorted(map(tuple, reshape.union_fill(a, b).collect())) == [(1, "x", None), (2, None, 5)]
    tagged = reshape.union_tagged({"one": a, "two": a})
    assert sorted(r.source for r in tagged.collect()) == ["one", "two"]
    assert reshape.union_distinct(a, a).count() == 1
    lists = spark.createDataFrame([("l1", "a"), ("l1", "b"), ("l2", "b"), ("l2", None)], "l string, i string")
    known = spark.createDataFrame([("a",), ("a",)], "i string")
    got = sorted(map(tuple, reshape.missing_items(lists, known, "l", "i").select("l", "i").collect()), key=str)
    assert set(got) == {("l1", "b"), ("l2", None), ("l2", "b")}


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`a b` int, `a(b` int, `1st` int, ok int")
    assert schema.clean_names(df).columns == ["a_b", "a_b_1", "X1st", "ok"]
    df = schema.clean_names(df)
    assert schema.name_range(df, "a_b_1", "ok") == ["a_b_1", "X1st", "ok"]
    assert schema.position_range(df, (1, 1), (3, 4)) == ["a_b", "X1st", "ok"]
    assert schema.reorder(df, ["ok"]).columns == ["ok", "a_b", "a_b_1", "X1st"]
    assert schema.columns_matching(df, "(?i)^A_") == ["a_b", "a_b_1"]
    same = schema.schema_diff(df.select("a_b", "ok"), df.select("ok", "X1st"))
    got = {r.column_name: (r.in_left, r.in_right) for r in same.collect()}
    assert got == {"a_b": (True, False), "ok": (True, True), "X1st": (False, True)}


def test_large_samples_are_cut_off_at_the_nth_value(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("w"), F.floor(F.col("id") / 3).alias("third")).repartition(5)
    key = lambda rows: sorted(map(tuple, rows.collect()))
    draws = {
        "plain": lambda: sampling.sample_n(df, 700, ["id"], 1),
        "weighted": lambda: sampling.weighted_sample_n(df, 700, F.col("w"), ["id"], 1),
        "logarithm": lambda: sampling.weighted_sample_n(df, 700, F.ln(F.col("w") + 1) * 300, ["id"], 1, log_weight=True),
        # three rows share each draw
        "ties": lambda: sampling.first_n(df.withColumn("u", F.col("third").cast("double")), 700, "u", ["id"]),
        "all": lambda: sampling.sample_n(df, 5000, ["id"], 1),
        "none": lambda: sampling.sample_n(df.filter("id < 0"), 10, ["id"], 1),
    }
    small = {name: key(draw()) for name, draw in draws.items()}
    monkeypatch.setattr(sampling, "MOST_AT_ONCE", 5)
    for name, draw in draws.items():
        large = draw()
        if name not in ("ties", "none"):
            assert len(small[name]) in (700, 3000)
        assert key(large) == small[name], name


def test_a_tenth_of_lineitem_without_a_top_n(spark, monkeypatch):
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey", "l_linenumber")
    keys = ["l_orderkey", "l_linenumber"]
    n = lines.count() // 10
    small = sampling.sample_n(lines, n, keys, 3)
    monkeypatch.setattr(sampling, "MOST_AT_ONCE", 100)
    large = sampling.sample_n(lines, n, keys, 3)
    below = large._jdf.queryExecution().executedPlan().toString()
    assert f"TakeOrderedAndProject(limit={n}" not in below and large.count() == n
    assert large.exceptAll(small).count() == 0
