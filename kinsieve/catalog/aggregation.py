"""Counts, shares, distributions, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsieve.catalog import query
from kinsieve.catalog.standins import (
    BY_SPECIMEN_CTE,
    LOG_CTE,
    SPECIMENS_CTE,
    STOCKS_CTE,
    patient_log,
    round_sql,
    specimens,
    stocks,
    table,
)
from kinsieve.functions import codes
from kinsieve.functions.numbers import guarded_product, round_even
from kinsieve.operators import summaries
from kinsieve.operators.ordered import asc, step_distribution
from kinsieve.operators.reshape import string_agg
from kinsieve.plans import cohort, selection
from kinsieve.plans.report import family_composition as composition

C = F.col


def rounded(df, digits, *names):
    return df.withColumns({n: round_even(C(n), digits) for n in names})


@query(
    f"""WITH {SPECIMENS_CTE}, m AS (SELECT DISTINCT subject_code AS code FROM specimens WHERE tissue = 'MW'),
    f AS (SELECT substr(code, 1, 8) AS family, string_agg(CASE WHEN substr(code, 9) LIKE 'S%' THEN 'SI' ELSE substr(code, 9) END, ', '
      ORDER BY CASE WHEN substr(code, 9) LIKE 'S%' THEN 'SI' ELSE substr(code, 9) END) AS relationships FROM m GROUP BY 1)
    SELECT relationships, count(*) AS n, {round_sql('count(*)::DOUBLE / (SELECT count(*) FROM f)', 2)} AS share FROM f GROUP BY 1"""
)
def family_composition(spark, d):
    """Families by which members gave a mouthwash specimen."""
    return composition(specimens(spark, d).filter(C("tissue") == "MW").select("subject_code").distinct())


@query("SELECT l_returnflag, l_linestatus, l_quantity >= 25 AS large, count(*) AS n FROM lineitem GROUP BY ALL")
def group_count(spark, d):
    return summaries.counts_by(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", (C("l_quantity") >= 25).alias("large"))


@query(
    f"""WITH {LOG_CTE} SELECT race, count(*) AS n, {round_sql('count(*)::DOUBLE / (SELECT count(*) FROM patient_log)', 2)} AS share
    FROM patient_log GROUP BY 1"""
)
def proportion_table(spark, d):
    return summaries.shares_by(patient_log(spark, d), "race")


@query(
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
    {round_sql('quantile_cont(l_extendedprice, 0.1)', 4)} AS p10, {round_sql('quantile_cont(l_extendedprice, 0.5)', 4)} AS p50,
    {round_sql('quantile_cont(l_quantity, 0.9)', 4)} AS p90_quantity FROM lineitem GROUP BY 1, 2"""
)
def group_stats(spark, d):
    out = summaries.group_stats(
        table(spark, d, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        {"n": F.count("*"), "low": F.min("l_extendedprice"), "high": F.max("l_extendedprice")},
        {"p10": ("l_extendedprice", 0.1), "p50": ("l_extendedprice", 0.5), "p90_quantity": ("l_quantity", 0.9)},
    )
    return rounded(out, 4, "p10", "p50", "p90_quantity")


@query(
    f"""WITH {BY_SPECIMEN_CTE} SELECT subject_code, date_diff('day', min(enroll_date), max(enroll_date))::INT AS gap, min(enroll_date) AS first,
    max(enroll_date) AS last FROM by_specimen GROUP BY 1 HAVING date_diff('day', min(enroll_date), max(enroll_date)) > 0"""
)
def date_gap_by_subject(spark, d):
    view = cohort.specimen_view(patient_log(spark, d), specimens(spark, d))
    gaps = view.groupBy("subject_code").agg(F.min("enroll_date").alias("first"), F.max("enroll_date").alias("last"))
    return gaps.withColumn("gap", F.datediff("last", "first")).filter(C("gap") > 0)


@query(f"WITH {SPECIMENS_CTE} SELECT subject_code, count(*) AS n FROM specimens GROUP BY 1 HAVING count(*) > 2")
def count_having(spark, d):
    return summaries.counts_by(specimens(spark, d), "subject_code").filter(C("n") > 2)


@query(
    f"""WITH {BY_SPECIMEN_CTE} SELECT family, bool_or(relationship = 'FA') AS father, bool_or(relationship = 'MO') AS mother,
    (1 + bool_or(relationship = 'FA')::INT + bool_or(relationship = 'MO')::INT)::INT AS trio_number,
    CASE 1 + bool_or(relationship = 'FA')::INT + bool_or(relationship = 'MO')::INT WHEN 1 THEN 'solo' WHEN 2 THEN 'duo' ELSE 'trio' END AS trio
    FROM by_specimen GROUP BY 1"""
)
def trio_status(spark, d):
    code = C("subject_code")
    members = specimens(spark, d).select(
        codes.family_of(code).alias("family"), codes.relationship_of(code).alias("relationship")
    )
    return selection.trio_status(members)


@query(
    f"""WITH {SPECIMENS_CTE}, h AS (SELECT substr(subject_code, 1, 8) AS family, sum(CASE tissue WHEN 'WB' THEN 10 WHEN 'MW' THEN 4 WHEN 'BUC' THEN 3
      WHEN 'LRNXP' THEN 5 ELSE 0 END)::BIGINT AS tissue_score, count(DISTINCT subject_code) AS members,
      (1 + max((substr(subject_code, 9, 2) = 'FA')::INT) + max((substr(subject_code, 9, 2) = 'MO')::INT))::INT AS trio_number FROM specimens GROUP BY 1)
    SELECT *, {round_sql('pow(trio_number - 1, 3) * tissue_score * tissue_score / members', 4)} AS value FROM h"""
)
def family_holdings(spark, d):
    return rounded(selection.family_holdings(specimens(spark, d)), 4, "value")


@query(
    f"""WITH {SPECIMENS_CTE}, {STOCKS_CTE}, q AS (SELECT substr(s.subject_code, 1, 8) AS family, s.specimen_id,
      CASE WHEN s.tissue <> 'LRNXP' THEN 1 + t.ratio_low END AS quality, t.conc FROM specimens s JOIN stocks t ON s.specimen_id = t.specimen_id),
    g AS (SELECT family, CASE WHEN count(quality) = count(*) THEN product(quality) * max(conc) END AS family_score FROM q GROUP BY 1)
    SELECT q.specimen_id, q.family, {round_sql('g.family_score', 4)} AS family_score FROM q JOIN g ON q.family = g.family"""
)
def group_product_score(spark, d):
    from kinsieve.operators.joins import salted_join

    rows = specimens(spark, d).join(stocks(spark, d), "specimen_id").select(
        codes.family_of(C("subject_code")).alias("family"),
        "specimen_id",
        F.when(C("tissue") != "LRNXP", C("ratio_low") + 1).alias("quality"),
        "conc",
    )
    scores = rows.groupBy("family").agg((guarded_product(C("quality")) * F.max("conc")).alias("family_score"))
    return rounded(salted_join(rows.select("specimen_id", "family"), scores, ["family"], "inner"), 4, "family_score")


@query(
    """SELECT o_custkey, string_agg(o_orderstatus || '-' || substr(o_orderpriority, 1, 1), ',' ORDER BY o_orderstatus || '-' || substr(o_orderpriority, 1, 1)) AS history
    FROM orders GROUP BY 1""",
    name="string_agg",
)
def string_aggregate(spark, d):
    item = F.concat_ws("-", "o_orderstatus", F.substring("o_orderpriority", 1, 1))
    return string_agg(table(spark, d, "orders").select("o_custkey", item.alias("item")), ["o_custkey"], "item", "history", ",")


_FLAGS = "sum(coalesce(surg_life >= 10, false)::INT)", "sum(coalesce(surg_12m >= 4, false)::INT)", "sum(coalesce(trach_log <> 'Never', false)::INT)"


@query(
    f"""WITH {LOG_CTE} SELECT 'count' AS measure, {_FLAGS[0]}::DOUBLE AS surg, {_FLAGS[1]}::DOUBLE AS freq, {_FLAGS[2]}::DOUBLE AS trach FROM patient_log
    UNION ALL SELECT 'share', {round_sql(_FLAGS[0] + '::DOUBLE / count(*)', 2)}, {round_sql(_FLAGS[1] + '::DOUBLE / count(*)', 2)},
    {round_sql(_FLAGS[2] + '::DOUBLE / count(*)', 2)} FROM patient_log"""
)
def flag_totals(spark, d):
    flags = patient_log(spark, d).select(
        (C("surg_life") >= 10).alias("surg"), (C("surg_12m") >= 4).alias("freq"), (C("trach_log") != "Never").alias("trach")
    )
    return summaries.flag_totals(flags, ["surg", "freq", "trach"])


@query(f"WITH {LOG_CTE} SELECT trach_log, site_pulmonary, site_bronchus, count(*) AS n FROM patient_log GROUP BY ALL")
def crosstab(spark, d):
    return summaries.counts_by(patient_log(spark, d), "trach_log", "site_pulmonary", "site_bronchus")


@query(
    """SELECT coalesce(l_returnflag, 'Sum') AS l_returnflag, coalesce(l_linestatus, 'Sum') AS l_linestatus, count(*) AS n FROM lineitem
    GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def crosstab_margins(spark, d):
    margin = lambda c: F.when(F.grouping(c) == 1, "Sum").otherwise(C(c)).alias(c + "_")
    cube = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), margin("l_returnflag"), margin("l_linestatus")
    )
    return cube.select(C("l_returnflag_").alias("l_returnflag"), C("l_linestatus_").alias("l_linestatus"), "n")


@query(
    """SELECT regexp_extract(text, '[^0-9 ]+') AS kind, count(*) AS n FROM documents WHERE regexp_extract(text, '[^0-9 ]+') <> '' GROUP BY 1"""
)
def extracted_type_counts(spark, d):
    kinds = table(spark, d, "documents").select(codes.first_match(C("text"), "[^0-9 ]+").alias("kind"))
    return summaries.counts_by(kinds.filter(C("kind").isNotNull()), "kind").orderBy(C("n").desc(), "kind")


def _summary_sql(column):
    return (
        f"SELECT '{column}' AS column_name, min({column})::DOUBLE AS min, {round_sql(f'avg({column})', 4)} AS mean, max({column})::DOUBLE AS max,"
        f" count(*) - count({column}) AS missing, {round_sql(f'quantile_cont({column}, 0.25)', 4)} AS q1,"
        f" {round_sql(f'quantile_cont({column}, 0.5)', 4)} AS median, {round_sql(f'quantile_cont({column}, 0.75)', 4)} AS q3 FROM lineitem"
    )


@query(" UNION ALL ".join(_summary_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def column_summary(spark, d):
    out = summaries.column_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(out, 4, "mean", "q1", "median", "q3")


@query(
    f"""WITH {LOG_CTE} SELECT 'trach_log' AS column_name, trach_log AS level, count(*) AS n FROM patient_log GROUP BY 2
    UNION ALL SELECT 'surg_style', surg_style, count(*) FROM patient_log GROUP BY 2"""
)
def level_summary(spark, d):
    return summaries.level_summary(patient_log(spark, d), ["trach_log", "surg_style"])


@query(
    """SELECT 'customer' AS table_name, count(*) AS n_rows, 5 AS n_columns FROM customer UNION ALL SELECT 'orders', count(*), 6 FROM orders
    UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem UNION ALL SELECT 'labels', count(*), 3 FROM labels"""
)
def table_profile(spark, d):
    return summaries.table_profile({n: table(spark, d, n) for n in ("customer", "orders", "lineitem", "labels")})


_POINTS = (3, 5, 10, 15, 18, 20, 25, 30, 50)


@query(
    f"""SELECT p AS point, {round_sql('sum((l_quantity <= p)::INT)::DOUBLE / count(l_quantity)', 2)} AS quantity,
    {round_sql('sum((l_extendedprice / 2000 <= p)::INT)::DOUBLE / count(l_extendedprice)', 2)} AS price
    FROM lineitem, (SELECT unnest([{', '.join(f'{p}.0::DOUBLE' for p in _POINTS)}]) AS p) GROUP BY p"""
)
def ecdf_at_points(spark, d):
    lines = table(spark, d, "lineitem").withColumn("k", C("l_extendedprice") / 2000)
    return summaries.shares_at_or_below(lines, {"quantity": "l_quantity", "price": "k"}, _POINTS)


@query(
    f"""WITH v AS (SELECT o_totalprice, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_totalprice, n, {round_sql('sum(n) OVER (ORDER BY o_totalprice) / sum(n) OVER ()', 6)} AS share FROM v"""
)
def ecdf_steps(spark, d):
    return rounded(step_distribution(table(spark, d, "orders"), "o_totalprice"), 6, "share")


@query("SELECT floor(l_quantity / 5) * 5.0::DOUBLE AS bin_start, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_width(spark, d):
    return summaries.histogram_by_width(table(spark, d, "lineitem"), "l_quantity", 5.0)


@query(
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT greatest(1, least(30, ceil((l_extendedprice - lo) * 30 / (hi - lo))))::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1"""
)
def histogram_bins(spark, d):
    return summaries.histogram_by_count(table(spark, d, "lineitem"), "l_extendedprice", 30)


@query(
    f"""WITH b AS (SELECT l_returnflag, floor(l_extendedprice / 2500) * 2500.0::DOUBLE AS bin_start, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT *, {round_sql('n / (sum(n) OVER (PARTITION BY l_returnflag) * 2500.0::DOUBLE) * 1000000', 4)} AS density_ppm FROM b"""
)
def histogram_density(spark, d):
    out = summaries.histogram_by_width(table(spark, d, "lineitem"), "l_extendedprice", 2500.0, ["l_returnflag"], density=True)
    return out.select("l_returnflag", "bin_start", "n", round_even(C("density") * 1000000, 4).alias("density_ppm"))


@query(
    f"""WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
      quantile_cont(o_totalprice, 0.75) AS q3 FROM (SELECT o_orderstatus, o_totalprice * o_totalprice AS o_totalprice FROM orders) GROUP BY 1),
    r AS (SELECT o_orderstatus, o_totalprice * o_totalprice AS v FROM orders)
    SELECT o_orderstatus, {round_sql('q1', 0)} AS q1, {round_sql('median', 0)} AS median, {round_sql('q3', 0)} AS q3,
    min(CASE WHEN v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 THEN v END) AS whisker_low,
    max(CASE WHEN v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 THEN v END) AS whisker_high,
    count(CASE WHEN NOT v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 THEN 1 END) AS outliers
    FROM r JOIN q USING (o_orderstatus) GROUP BY 1, q1, median, q3"""
)
def box_stats(spark, d):
    squared = table(spark, d, "orders").select("o_orderstatus", (C("o_totalprice") * C("o_totalprice")).alias("v"))
    return rounded(summaries.box_stats(squared, "v", ["o_orderstatus"]), 0, "q1", "median", "q3")


@query(
    f"""SELECT l_linenumber, count(l_extendedprice) AS n, {round_sql('avg(l_extendedprice)', 3)} AS mean, {round_sql('stddev_samp(l_extendedprice)', 3)} AS sd,
    {round_sql('stddev_samp(l_extendedprice) / sqrt(count(*))', 4)} AS se FROM lineitem GROUP BY 1"""
)
def group_means(spark, d):
    out = summaries.group_means(table(spark, d, "lineitem"), "l_extendedprice", ["l_linenumber"])
    return rounded(rounded(out, 3, "mean", "sd"), 4, "se")


# the t quantile at 97.5 % as the normal one with its first corrections; the groups have hundreds of rows
_Z = "1.959963984540054::DOUBLE"
_T_QUANTILE = (
    f"({_Z} + ({_Z}^3 + {_Z}) / (4 * k) + (5 * {_Z}^5 + 16 * {_Z}^3 + 3 * {_Z}) / (96 * k * k)"
    f" + (3 * {_Z}^7 + 19 * {_Z}^5 + 17 * {_Z}^3 - 15 * {_Z}) / (384 * k * k * k))"
)


@query(
    f"""WITH g AS (SELECT l_linenumber, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, (count(*) - 1)::DOUBLE AS k FROM lineitem GROUP BY 1)
    SELECT l_linenumber, n, {round_sql('mean', 3)} AS mean, {round_sql('sd', 3)} AS sd, {round_sql('sd / sqrt(n)', 4)} AS se,
    {round_sql(f'mean - {_T_QUANTILE} * sd / sqrt(n)', 2)} AS low, {round_sql(f'mean + {_T_QUANTILE} * sd / sqrt(n)', 2)} AS high FROM g"""
)
def group_means_ci(spark, d):
    out = summaries.group_means_interval(table(spark, d, "lineitem"), "l_extendedprice", ["l_linenumber"])
    return rounded(rounded(rounded(out, 3, "mean", "sd"), 4, "se"), 2, "low", "high")


@query(
    f"""WITH {BY_SPECIMEN_CTE} SELECT (CASE sex WHEN 'Female' THEN 'F' WHEN 'Male' THEN 'M' END) = subj_sex AS same, count(*) AS n FROM by_specimen GROUP BY 1"""
)
def agreement_count(spark, d):
    view = cohort.specimen_view(patient_log(spark, d), specimens(spark, d))
    return summaries.agreement(view.withColumn("logged", F.substring("sex", 1, 1)), "logged", "subj_sex")


@query(
    f"""WITH {SPECIMENS_CTE} SELECT count(*) AS n, count(DISTINCT subject_code) AS subjects, sum((tissue = 'WB')::INT)::BIGINT AS blood,
    sum((substr(subject_code, 9) IN ('FA', 'MO'))::INT)::BIGINT AS parents, max(recd_date) AS latest FROM specimens"""
)
def scalar_totals(spark, d):
    return specimens(spark, d).agg(
        F.count("*").alias("n"),
        F.count_distinct("subject_code").alias("subjects"),
        F.sum((C("tissue") == "WB").cast("int")).alias("blood"),
        F.sum(codes.suffix_of(C("subject_code")).isin(*codes.PARENTS).cast("int")).alias("parents"),
        F.max("recd_date").alias("latest"),
    )


@query(
    f"""WITH {STOCKS_CTE}, m AS (SELECT floor(ratio_low * 20)::BIGINT AS missed, conc FROM stocks), g AS (SELECT missed, count(*) AS n FROM m WHERE conc < 100 GROUP BY 1)
    SELECT missed, n, {round_sql('sum(n) OVER (ORDER BY missed)::DOUBLE / (SELECT count(*) FROM m)', 3)} AS cumulative FROM g"""
)
def cumulative_share(spark, d):
    """Running share of a filtered subset over the unfiltered total."""
    all_stocks = stocks(spark, d).select(F.floor(C("ratio_low") * 20).alias("missed"), "conc")
    return summaries.cumulative_shares(all_stocks.filter(C("conc") < 100), "missed", [asc("missed")], total=all_stocks)
