"""Regressions and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsieve.catalog import query
from kinsieve.catalog.standins import STOCKS_CTE, round_sql, signif_sql, stocks, table
from kinsieve.functions.numbers import bin_label, round_even, signif
from kinsieve.functions.tails import HART_ABOVE, HART_BELOW
from kinsieve.operators import statistics
from kinsieve.operators.reshape import union_fill

C = F.col


def significant(df, digits, *names):
    return df.withColumns({n: signif(C(n), digits) for n in names})


@query(
    f"""WITH m AS (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
      regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx,
      regr_syy(l_extendedprice, l_quantity) AS syy, regr_avgx(l_extendedprice, l_quantity) AS mx FROM lineitem),
    s AS (SELECT *, sqrt((1 - r2) * syy / (n - 2)) AS sigma FROM m),
    e AS (SELECT *, sigma / sqrt(sxx) AS se_slope, sigma * sqrt(1.0::DOUBLE / n + mx * mx / sxx) AS se_intercept FROM s)
    SELECT n::BIGINT AS n, {signif_sql('intercept', 6)} AS intercept, {signif_sql('slope', 6)} AS slope, {signif_sql('se_intercept', 6)} AS se_intercept,
    {signif_sql('se_slope', 6)} AS se_slope, {signif_sql('(intercept / se_intercept)', 6)} AS t_intercept, {signif_sql('(slope / se_slope)', 6)} AS t_slope,
    {signif_sql('r2', 6)} AS r_squared, {signif_sql('sigma', 6)} AS sigma FROM e"""
)
def ols_simple(spark, d):
    out = statistics.simple_regression(table(spark, d, "lineitem"), C("l_extendedprice"), C("l_quantity"))
    return significant(out, 6, "intercept", "slope", "se_intercept", "se_slope", "t_intercept", "t_slope", "r_squared", "sigma")


@query(
    f"""WITH g AS (SELECT l_linestatus AS k, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
      regr_sxx(l_extendedprice, l_quantity) AS sxx, avg(l_quantity) AS mx,
      regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) AS rss FROM lineitem GROUP BY 1),
    w AS (SELECT max(CASE WHEN k = 'F' THEN a END) AS af, max(CASE WHEN k = 'F' THEN b END) AS bf, max(CASE WHEN k = 'O' THEN a END) AS ao,
      max(CASE WHEN k = 'O' THEN b END) AS bo, sum(rss) / (sum(n) - 4) AS s2, max(CASE WHEN k = 'F' THEN sxx END) AS xf, max(CASE WHEN k = 'O' THEN sxx END) AS xo,
      max(CASE WHEN k = 'F' THEN 1.0::DOUBLE / n + mx * mx / sxx END) AS vf, max(CASE WHEN k = 'O' THEN 1.0::DOUBLE / n + mx * mx / sxx END) AS vo FROM g),
    t AS (SELECT '(Intercept)' AS term, af AS estimate, sqrt(s2 * vf) AS se FROM w UNION ALL SELECT 'l_quantity', bf, sqrt(s2 / xf) FROM w
      UNION ALL SELECT 'l_linestatus[O]', ao - af, sqrt(s2 * (vf + vo)) FROM w
      UNION ALL SELECT 'l_quantity:l_linestatus[O]', bo - bf, sqrt(s2 * (1 / xf + 1 / xo)) FROM w)
    SELECT term, {signif_sql('estimate', 5)} AS estimate, {signif_sql('se', 5)} AS se, {signif_sql('(estimate / se)', 4)} AS t FROM t"""
)
def ols_interaction(spark, d):
    """Slope and level of two categories in one model: y ~ x * category."""
    out = statistics.model_regression(
        table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_linestatus"], [("l_quantity", "l_linestatus")]
    )
    return significant(significant(out.drop("p"), 5, "estimate", "se"), 4, "t")


@query(
    f"""WITH g AS (SELECT l_returnflag AS k, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_sxx(l_extendedprice, l_quantity) AS sxx,
      regr_sxy(l_extendedprice, l_quantity) AS sxy, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem GROUP BY 1),
    w AS (SELECT sum(sxy) / sum(sxx) AS b, sum(sxx) AS sxx, (sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(n) - count(*) - 1) AS s2 FROM g),
    f AS (SELECT * FROM g ORDER BY k LIMIT 1),
    t AS (SELECT '(Intercept)' AS term, f.my - b * f.mx AS estimate, sqrt(s2 * (1.0::DOUBLE / f.n + f.mx * f.mx / w.sxx)) AS se FROM f, w
      UNION ALL SELECT 'l_quantity', b, sqrt(s2 / sxx) FROM w
      UNION ALL SELECT 'l_returnflag[' || g.k || ']', (g.my - b * g.mx) - (f.my - b * f.mx), sqrt(s2 * (1.0::DOUBLE / f.n + 1.0::DOUBLE / g.n + (g.mx - f.mx) * (g.mx - f.mx) / w.sxx))
        FROM g, f, w WHERE g.k <> f.k)
    SELECT term, {signif_sql('estimate', 5)} AS estimate, {signif_sql('se', 5)} AS se, {signif_sql('(estimate / se)', 4)} AS t FROM t"""
)
def ols_category(spark, d):
    """Model with a text category: every category but one gets a term."""
    out = statistics.model_regression(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_returnflag"])
    return significant(significant(out.drop("p"), 5, "estimate", "se"), 4, "t")


@query(
    f"""WITH {STOCKS_CTE}, v AS (SELECT log2(yield_ug) AS y, extract_date > DATE '1998-01-01' AS s FROM stocks WHERE yield_ug > 0),
    m AS (SELECT count(*) FILTER (NOT s) AS n0, count(*) FILTER (s) AS n1, avg(y) FILTER (NOT s) AS m0, avg(y) FILTER (s) AS m1,
      var_samp(y) FILTER (NOT s) / count(*) FILTER (NOT s) AS v0, var_samp(y) FILTER (s) / count(*) FILTER (s) AS v1 FROM v)
    SELECT n0 AS n_false, n1 AS n_true, {round_sql('m0', 6)} AS mean_false, {round_sql('m1', 6)} AS mean_true, {round_sql('(m0 - m1) / sqrt(v0 + v1)', 5)} AS t,
    {round_sql('(v0 + v1) * (v0 + v1) / (v0 * v0 / (n0 - 1) + v1 * v1 / (n1 - 1))', 3)} AS df FROM m"""
)
def welch_t(spark, d):
    known = stocks(spark, d).filter(C("yield_ug") > 0)
    out = statistics.welch_test(known, F.log2("yield_ug"), C("extract_date") > F.lit("1998-01-01").cast("date"))
    return out.withColumns(
        {
            "mean_false": round_even(C("mean_false"), 6),
            "mean_true": round_even(C("mean_true"), 6),
            "t": round_even(C("t"), 5),
            "df": round_even(C("df"), 3),
        }
    )


_BINS = "CASE WHEN ratio_low > -1 AND ratio_low <= 0.05 THEN 'a none' WHEN ratio_low > 0.05 AND ratio_low <= 0.15 THEN 'b some' WHEN ratio_low > 0.15 AND ratio_low <= 44 THEN 'c many' END"
_LEVELS = f"""{STOCKS_CTE}, v AS (SELECT conc AS y, {_BINS} AS level FROM stocks),
    g AS (SELECT level, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w FROM v WHERE level IS NOT NULL GROUP BY 1)"""


def _binned(spark, d):
    level = bin_label(C("ratio_low"), [-1, 0.05, 0.15, 44], ["a none", "b some", "c many"])
    return stocks(spark, d).select("conc", level.alias("level"))


@query(
    f"""WITH {_LEVELS}, s AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(w) AS sw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS sb FROM g)
    SELECT k - 1 AS df_between, n - k AS df_within, {signif_sql('sb', 5)} AS ss_between, {signif_sql('sw', 5)} AS ss_within,
    {signif_sql('((sb / (k - 1)) / (sw / (n - k)))', 5)} AS f FROM s"""
)
def anova_oneway(spark, d):
    out = statistics.one_way_anova(_binned(spark, d), C("conc"), C("level"))
    return significant(out, 5, "ss_between", "ss_within", "f")


@query(
    f"""WITH {_LEVELS}, s AS (SELECT sum(w) / (sum(n) - count(*)) AS mse, (sum(n) - count(*))::BIGINT AS df FROM g)
    SELECT a.level AS level_a, b.level AS level_b, {signif_sql('(b.m - a.m)', 5)} AS difference,
    {signif_sql('(abs(b.m - a.m) / sqrt(mse / 2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)))', 5)} AS q, df
    FROM g a JOIN g b ON a.level < b.level, s"""
)
def tukey_pairs(spark, d):
    out = statistics.honest_differences(_binned(spark, d), C("conc"), C("level"))
    return significant(out, 5, "difference", "q")


def _horner_sql(coefficients, x):
    sql = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        sql = f"({sql} * {x} + {c!r}::DOUBLE)"
    return sql


def normal_sql(x):
    """The normal distribution function of an expression of SQL."""
    tail = f"CASE WHEN abs({x}) < 7 THEN exp(-({x}) * ({x}) / 2) * {_horner_sql(HART_ABOVE, f'abs({x})')} / {_horner_sql(HART_BELOW, f'abs({x})')} ELSE 0 END"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


# F and t: with x = sin² the beta integral is one of powers of sine and cosine. Studentised range: a plain grid.
@query(
    f"""WITH {_LEVELS}, y AS (SELECT 'yield' AS what, log2(yield_ug) AS y, extract_date > DATE '1998-01-01' AS s FROM stocks WHERE yield_ug > 0
      UNION ALL SELECT 'quantity', l_quantity, l_linestatus = 'O' FROM lineitem),
    m AS (SELECT what, count(*) FILTER (NOT s) AS n0, count(*) FILTER (s) AS n1, avg(y) FILTER (NOT s) AS m0, avg(y) FILTER (s) AS m1,
      var_samp(y) FILTER (NOT s) / count(*) FILTER (NOT s) AS v0, var_samp(y) FILTER (s) / count(*) FILTER (s) AS v1 FROM y GROUP BY what),
    o AS (SELECT 'conc' AS what, * FROM g
      UNION ALL SELECT 'quantity', l_linenumber::VARCHAR, count(*), avg(l_quantity), var_pop(l_quantity) * count(*) FROM lineitem GROUP BY l_linenumber),
    s AS (SELECT what, count(*)::DOUBLE AS levels, sum(n)::DOUBLE AS total, sum(w) AS sw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS sb FROM o GROUP BY what),
    f AS (SELECT 'welch ' || what AS test, (m0 - m1) * (m0 - m1) / (v0 + v1) AS f, 1.0::DOUBLE AS d1, (v0 + v1) * (v0 + v1) / (v0 * v0 / (n0 - 1) + v1 * v1 / (n1 - 1)) AS d2 FROM m
      UNION ALL SELECT 'anova ' || what, (sb / (levels - 1)) / (sw / (total - levels)), levels - 1, total - levels FROM s),
    a AS (SELECT test, d1, d2, atan(sqrt(d1 * f / d2)) AS least FROM f),
    angles AS (SELECT *, least + (i + 0.5) / 200000 * (pi() / 2 - least) AS upper, (i + 0.5) / 200000 * pi() / 2 AS every FROM a, range(200000) r(i)),
    beta AS (SELECT test, sum(pow(sin(upper), d1 - 1) * pow(cos(upper), d2 - 1) * (pi() / 2 - least)) / sum(pow(sin(every), d1 - 1) * pow(cos(every), d2 - 1) * pi() / 2) AS p
      FROM angles GROUP BY test),
    pairs AS (SELECT s.what || ' ' || a.level || ' / ' || b.level AS test, levels, total - levels AS df,
      abs(b.m - a.m) / sqrt(sw / (total - levels) / 2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS q FROM o a JOIN o b ON a.what = b.what AND a.level < b.level JOIN s ON s.what = a.what),
    deviations AS (SELECT *, greatest(1e-6, 1 - 8 / sqrt(2 * df)) + (j + 0.5) / 300 * (1 + 8 / sqrt(2 * df) - greatest(1e-6, 1 - 8 / sqrt(2 * df))) AS d FROM pairs, range(300) r(j)),
    grid AS (SELECT test, levels, exp((df - 1) * ln(d) - df * (d * d - 1) / 2) AS h, (i + 0.5) / 400 * 16 - 8 AS z, q * d AS width FROM deviations, range(400) r(i)),
    edges AS (SELECT *, z - width AS z0 FROM grid),
    spread AS (SELECT test, levels, h, exp(-z * z / 2) / sqrt(2 * pi()) AS density, greatest(0, {normal_sql('z')} - {normal_sql('z0')}) AS between_them FROM edges),
    ranges AS (SELECT test, 1 - sum(h * density * levels * pow(between_them, levels - 1)) * 16 / sum(h) AS p FROM spread GROUP BY test)
    SELECT test, CASE WHEN p < 1e-16 THEN 0 ELSE {signif_sql('p', 5)} END AS p FROM beta
    UNION ALL SELECT test, {round_sql('least(1, greatest(0, p))', 6)} FROM ranges"""
)
def test_p_values(spark, d):
    """Tail areas of t tests, analyses of variance and pairwise differences (those below 1e-16 as 0)."""
    known, lines = stocks(spark, d).filter(C("yield_ug") > 0), table(spark, d, "lineitem")
    tests, pairs = [], []
    for what, df, y, split in (
        ("yield", known, F.log2("yield_ug"), C("extract_date") > F.lit("1998-01-01").cast("date")),
        ("quantity", lines, C("l_quantity"), C("l_linestatus") == "O"),
    ):
        tests.append(statistics.welch_test(df, y, split, p_values=True).select(F.lit(f"welch {what}").alias("test"), "p"))
    for what, df, y, level in (("conc", _binned(spark, d), "conc", "level"), ("quantity", lines.withColumn("line", C("l_linenumber").cast("string")), "l_quantity", "line")):
        tests.append(statistics.one_way_anova(df, C(y), C(level), p_values=True).select(F.lit(f"anova {what}").alias("test"), "p"))
        found = statistics.honest_differences(df, C(y), C(level), p_values=True)
        pairs.append(found.select(F.concat(F.lit(f"{what} "), "level_a", F.lit(" / "), "level_b").alias("test"), round_even(C("p"), 6).alias("p")))
    tests = union_fill(*tests).withColumn("p", F.when(C("p") < 1e-16, 0.0).otherwise(signif(C("p"), 5)))
    return union_fill(tests, *pairs)
