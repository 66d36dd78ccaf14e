"""Ranks, cumulative forms, fills, layouts, sorting, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsieve.catalog import query
from kinsieve.catalog.standins import (
    BY_SPECIMEN_CTE,
    SPECIMENS_CTE,
    STOCKS_CTE,
    patient_log,
    round_sql,
    specimens,
    stocks,
    subject_code,
    code_sql,
    table,
    uniform_sql,
)
from kinsieve.functions import codes
from kinsieve.functions.numbers import round_even, uniform, within
from kinsieve.operators import ordered, sampling, summaries
from kinsieve.operators.joins import first_per_key, salted_join, with_average_rank
from kinsieve.operators.ordered import asc, desc

C = F.col


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (ORDER BY l_extendedprice DESC) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS price_rank,
    rank() OVER (ORDER BY l_returnflag) + (count(*) OVER (PARTITION BY l_returnflag) - 1) / 2.0::DOUBLE AS flag_rank FROM lineitem"""
)
def avg_rank(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    ranked = with_average_rank(lines, "l_extendedprice", "price_rank", descending=True)
    return with_average_rank(ranked, "l_returnflag", "flag_rank").drop("l_extendedprice", "l_returnflag")


@query(
    """WITH r AS (SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS price_rank,
      rank() OVER (ORDER BY o_orderdate::DATE) + (count(*) OVER (PARTITION BY o_orderdate::DATE) - 1) / 2.0::DOUBLE AS date_rank FROM orders)
    SELECT o_orderkey, price_rank - date_rank AS rank_diff FROM r"""
)
def rank_difference(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    ranked = with_average_rank(with_average_rank(orders, "o_totalprice", "a"), "day", "b")
    return ranked.select("o_orderkey", (C("a") - C("b")).alias("rank_diff"))


@query(
    f"""WITH p AS (SELECT {code_sql('c_custkey')} AS subject_code, CASE WHEN c_acctbal > 3000 THEN c_mktsegment END AS segment FROM customer)
    SELECT subject_code, coalesce(last_value(segment IGNORE NULLS) OVER (PARTITION BY substr(subject_code, 1, 8) ORDER BY subject_code ROWS UNBOUNDED PRECEDING),
      first_value(segment IGNORE NULLS) OVER (PARTITION BY substr(subject_code, 1, 8) ORDER BY subject_code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS segment FROM p"""
)
def locf_family(spark, d):
    people = table(spark, d, "customer").select(
        subject_code(C("c_custkey")).alias("subject_code"), F.when(C("c_acctbal") > 3000, C("c_mktsegment")).alias("segment")
    ).withColumn("family", codes.family_of(C("subject_code")))
    return ordered.fill_missing(people, ["segment"], [asc("subject_code")], ["family"], both_ways=True).drop("family")


@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS plate FROM events"""
)
def locf_global(spark, d):
    events = table(spark, d, "events").select("event_id", F.when(C("event_type") == "signup", C("user_id")).alias("plate"))
    return ordered.fill_missing(events, ["plate"], [asc("event_id")])


@query(
    """WITH i AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, o_totalprice FROM i WHERE (i - 1) % 10 = 0 AND i <= n * 0.5"""
)
def every_kth(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ordered.every_kth(orders, 10, [desc("o_totalprice"), asc("o_orderkey")], 0.5)


@query(
    f"""WITH {STOCKS_CTE}, l AS (SELECT specimen_id, ln(CASE WHEN yield_ug > 0 THEN yield_ug END) AS v FROM stocks),
    m AS (SELECT avg(v) AS a, stddev_samp(v) AS s FROM l)
    SELECT specimen_id, {round_sql('CASE WHEN -((v - a) / s) < 1 THEN 1 ELSE -((v - a) / s) END', 6)} AS shortfall FROM l, m WHERE v IS NOT NULL"""
)
def zscore_clamp(spark, d):
    logs = stocks(spark, d).filter(C("yield_ug") > 0).select("specimen_id", F.ln("yield_ug").alias("v"))
    return summaries.z_score(logs, "v", "z").select("specimen_id", round_even(within(-C("z"), low=1.0), 6).alias("shortfall"))


@query(
    f"""WITH {SPECIMENS_CTE}, w AS (SELECT specimen_id, stock_id, row_number() OVER (PARTITION BY stock_id ORDER BY specimen_id) AS i,
      count(*) OVER (PARTITION BY stock_id) AS n FROM specimens)
    SELECT specimen_id, stock_id, i > 1 AS repeats_earlier, i < n AS repeated_later FROM w WHERE n > 1"""
)
def duplicated_rows(spark, d):
    rows = specimens(spark, d).select("specimen_id", "stock_id")
    repeated = rows.groupBy("stock_id").agg(F.min("specimen_id").alias("first"), F.max("specimen_id").alias("last"), F.count("*").alias("n"))
    marked = salted_join(rows, repeated.filter("n > 1"), ["stock_id"], null_safe=True)
    return marked.select(
        "specimen_id",
        "stock_id",
        (C("specimen_id") > C("first")).alias("repeats_earlier"),
        (C("specimen_id") < C("last")).alias("repeated_later"),
    )


@query(
    f"""WITH {SPECIMENS_CTE} SELECT specimen_id, subject_code, tissue FROM (SELECT *, row_number() OVER
    (PARTITION BY subject_code, tissue ORDER BY recd_date NULLS FIRST, specimen_id) AS i FROM specimens) WHERE i <> 2"""
)
def drop_nth_duplicate(spark, d):
    rows = specimens(spark, d).select("specimen_id", "subject_code", "tissue", "recd_date")
    numbered = ordered.with_index(rows, [asc("recd_date"), asc("specimen_id")], ["subject_code", "tissue"], "i")
    return numbered.filter(C("i") != 2).drop("i", "recd_date")


@query(
    f"""WITH {BY_SPECIMEN_CTE} SELECT subject_code, specimen_id, enroll_date FROM (SELECT *, row_number() OVER
    (PARTITION BY subject_code ORDER BY enroll_date NULLS FIRST, stock_id NULLS FIRST, specimen_id) AS i FROM by_specimen) WHERE i = 1""",
    name="first_per_key",
)
def first_specimen(spark, d):
    from kinsieve.plans.cohort import specimen_view

    view = specimen_view(patient_log(spark, d), specimens(spark, d)).select("subject_code", "specimen_id", "stock_id", "enroll_date")
    return first_per_key(view, ["subject_code"], [asc("enroll_date"), asc("stock_id"), asc("specimen_id")]).drop("stock_id")


@query(f"WITH {SPECIMENS_CTE} SELECT specimen_id, tissue, recd_date FROM specimens ORDER BY tissue DESC NULLS LAST, recd_date NULLS FIRST, specimen_id")
def sort_mixed(spark, d):
    rows = specimens(spark, d).select("specimen_id", "tissue", "recd_date")
    return rows.orderBy(*ordered.sort_expressions([desc("tissue"), asc("recd_date"), asc("specimen_id")]))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(C("o_totalprice").desc_nulls_last(), "o_orderkey").limit(25)


@query(f"SELECT o_orderkey FROM orders ORDER BY {uniform_sql(106, 'o_orderkey')}, o_orderkey LIMIT 106")
def sample_n(spark, d):
    return sampling.sample_n(table(spark, d, "orders").select("o_orderkey"), 106, ["o_orderkey"], 106)


@query(
    f"""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice - 50000 > 0
    ORDER BY -ln({uniform_sql(22, 'o_orderkey')}) / (o_totalprice - 50000), o_orderkey LIMIT 22"""
)
def weighted_sample_n(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sampling.weighted_sample_n(orders, 22, C("o_totalprice") - 50000, ["o_orderkey"], 22)


@query(f"SELECT c_custkey, (1 + floor({uniform_sql(5, 'c_custkey')} * 96))::INT AS hole FROM customer")
def random_integer(spark, d):
    return table(spark, d, "customer").select("c_custkey", sampling.random_integer(96, 5, C("c_custkey")).alias("hole"))
