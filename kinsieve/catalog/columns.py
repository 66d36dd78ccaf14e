"""Projection, column functions, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsieve.catalog import query
from kinsieve.catalog.standins import (
    BY_SPECIMEN_CTE,
    EDU_LEVELS,
    LOG_CTE,
    SPECIMENS_CTE,
    STOCKS_CTE,
    UPDATES_CTE,
    cents,
    cents_sql,
    clinical_updates,
    code_sql,
    patient_log,
    round_sql,
    signif_sql,
    specimens,
    stocks,
    subject_code,
    table,
)
from kinsieve.functions import codes, dates, numbers, recoding
from kinsieve.operators import schema
from kinsieve.operators.rules import Rule, apply_rules
from kinsieve.sources.tables import literal_table

C = F.col


@query(
    f"""SELECT o_orderkey AS specimen_id, substr({code_sql('o_custkey')}, 1, 8) AS family,
    {round_sql('o_totalprice / 1000', 2)} AS price_k FROM orders"""
)
def project(spark, d):
    return table(spark, d, "orders").select(
        C("o_orderkey").alias("specimen_id"),
        codes.family_of(subject_code(C("o_custkey"))).alias("family"),
        numbers.round_even(C("o_totalprice") / 1000, 2).alias("price_k"),
    )


@query(
    f"""SELECT l_orderkey, l_linenumber, {round_sql('l_extendedprice / 500 * l_quantity * 0.001::DOUBLE', 4)} AS yield_ug,
    {round_sql('CASE WHEN 1.5 + l_discount * 5 > 1.8 THEN 0 ELSE 1.8::DOUBLE - (1.5::DOUBLE + l_discount * 5) END', 6)} AS ratio_low
    FROM lineitem"""
)
def derive(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount")
    out = lines.withColumns({"conc": C("l_extendedprice") / 500, "abs_ratio": F.lit(1.5) + C("l_discount") * 5})
    return out.select(
        "l_orderkey",
        "l_linenumber",
        numbers.round_even(C("conc") * C("l_quantity") * 0.001, 4).alias("yield_ug"),
        numbers.round_even(
            F.when(C("abs_ratio") > 1.8, F.lit(0.0)).otherwise(1.8 - C("abs_ratio")), 6
        ).alias("ratio_low"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'P' THEN 'both'
      WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 400000 THEN 'large' ELSE 'none' END AS flag FROM orders"""
)
def conditional_update(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit("none").alias("flag"))
    return apply_rules(
        orders,
        [
            Rule("flag", C("o_totalprice") > 400000, "large"),
            Rule("flag", C("o_orderstatus") == "P", "pending"),
            Rule("flag", (C("flag") == "pending") & (C("o_totalprice") > 300000), "both"),
        ],
    ).select("o_orderkey", "flag")


@query("SELECT s_suppkey AS collab_key, s_name AS collab_name, s_nationkey, s_acctbal FROM supplier")
def rename(spark, d):
    return table(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "collab_key", "s_name": "collab_name"})


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(spark, d):
    return table(spark, d, "customer").drop("c_name", "c_acctbal")


@query("SELECT p_partkey, p_name, p_type, p_size FROM part")
def select_by_position(spark, d):
    part = table(spark, d, "part")
    return part.select(schema.position_range(part, (1, 2), (4, 5)))


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_name_range(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select(schema.name_range(lines, "l_quantity", "l_tax"))


@query("SELECT o_orderstatus, o_orderpriority, o_orderkey, o_custkey, o_totalprice FROM orders")
def reorder_columns(spark, d):
    return schema.reorder(table(spark, d, "orders").drop("o_orderdate"), ["o_orderstatus", "o_orderpriority"])


@query('SELECT n_nationkey AS "Nation_key", n_name AS "Name_en_", n_name AS "Name_en__1", n_regionkey AS "X2nd" FROM nation')
def clean_names(spark, d):
    nation = table(spark, d, "nation")
    odd = nation.select(
        C("n_nationkey").alias("Nation key"),
        C("n_name").alias("Name(en)"),
        C("n_name").alias("Name en)"),
        C("n_regionkey").alias("2nd"),
    )
    return schema.clean_names(odd)


@query(
    """SELECT 'l_linenumber' AS column_name, count(DISTINCT l_linenumber) AS n_values FROM lineitem
    UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem"""
)
def columns_matching(spark, d):
    lines = table(spark, d, "lineitem")
    found = schema.columns_matching(lines, "(?i)^l_LINE")
    counted = lines.agg(*[F.count_distinct(c).alias(c) for c in found])
    return counted.unpivot([], found, "column_name", "n_values")


@query(
    """WITH names(column_name, in_left, in_right, filled_left, filled_right) AS (
    SELECT 'specimen_id', true, true, count(o_orderkey), count(o_orderkey) FROM orders
    UNION ALL SELECT 'status', true, false, count(o_orderstatus), NULL FROM orders
    UNION ALL SELECT 'family', false, true, NULL, count(o_custkey) FROM orders)
    SELECT * FROM names"""
)
def schema_diff(spark, d):
    orders = table(spark, d, "orders")
    left = orders.select(C("o_orderkey").alias("specimen_id"), C("o_orderstatus").alias("status"))
    right = orders.select(C("o_orderkey").alias("specimen_id"), codes.family_of(subject_code(C("o_custkey"))).alias("family"))
    return schema.schema_diff(left, right)


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0) AS l_extendedprice, round_even(l_quantity, 0) AS l_quantity FROM lineitem")
def apply_columns(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return schema.apply_to(lines, ["l_extendedprice", "l_quantity"], numbers.round_even)


@query(
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 4
    WHEN '4-NOT SPECIFIED' THEN 3 WHEN '3-MEDIUM' THEN 5 ELSE 0 END AS tissue_score FROM orders"""
)
def recode(spark, d):
    scores = {"1-URGENT": 10, "2-HIGH": 4, "4-NOT SPECIFIED": 3, "3-MEDIUM": 5}
    return table(spark, d, "orders").select(
        "o_orderkey", recoding.recode(C("o_orderpriority"), scores, 0).alias("tissue_score")
    )


_EDU = "['Grade9','Grade12','HighSchool','CollegeSome','AssociateDeg','Bachelor','Graduate','Not Recorded']"


@query(
    f"""WITH e AS (SELECT c_custkey, {cents_sql('c_acctbal')} AS c FROM customer),
    f AS (SELECT c_custkey, (c % 8 + 1)::BIGINT AS a, ((c // 8) % 8 + 1)::BIGINT AS b FROM e),
    g AS (SELECT c_custkey, CASE WHEN a < 8 THEN a END AS na, CASE WHEN b < 8 THEN b END AS nb FROM f)
    SELECT c_custkey, na::INT AS edu_past_number, nb::INT AS edu_adult_number,
    list_extract({_EDU}, greatest(na, nb)) AS max_edu FROM g"""
)
def factor_encode(spark, d):
    c = cents(C("c_acctbal"))
    written = F.array(*[F.lit(v) for v in (*EDU_LEVELS, "Not Recorded")])
    edu = table(spark, d, "customer").select(
        "c_custkey",
        recoding.without_values(F.get(written, F.pmod(c, F.lit(8)).cast("int")), ["Not Recorded"]).alias("past"),
        recoding.without_values(F.get(written, F.pmod(F.floor(c / 8), F.lit(8)).cast("int")), ["Not Recorded"]).alias("adult"),
    )
    numbered = edu.select(
        "c_custkey",
        recoding.level_number(C("past"), EDU_LEVELS).alias("edu_past_number"),
        recoding.level_number(C("adult"), EDU_LEVELS).alias("edu_adult_number"),
    )
    top = numbers.row_max(C("edu_past_number"), C("edu_adult_number"))
    return numbered.withColumn("max_edu", recoding.level_label(top, EDU_LEVELS))


@query(
    f"""WITH {LOG_CTE} SELECT subject_code, greatest(surg_12m, surg_max_12m) AS most, least(surg_12m, surg_max_12m) AS least_known,
    CASE WHEN surg_12m IS NOT NULL AND surg_max_12m IS NOT NULL THEN greatest(surg_12m, surg_max_12m) END AS most_if_all
    FROM patient_log"""
)
def rowwise_extreme(spark, d):
    a, b = C("surg_12m"), C("surg_max_12m")
    return patient_log(spark, d).select(
        "subject_code",
        numbers.row_max(a, b).alias("most"),
        numbers.row_min(a, b).alias("least_known"),
        numbers.row_max(a, b, skip_nulls=False).alias("most_if_all"),
    )


@query(
    f"""WITH {LOG_CTE} SELECT subject_code, ((site_pulmonary IS NULL)::INT + (site_bronchus IS NULL)::INT + (site_trachea IS NULL)::INT
    + (surg_life IS NULL)::INT + (surg_12m IS NULL)::INT + (surg_max_12m IS NULL)::INT)::INT AS missing FROM patient_log"""
)
def row_null_count(spark, d):
    log = patient_log(spark, d)
    span = schema.name_range(log, "site_pulmonary", "surg_max_12m")
    return log.select("subject_code", numbers.null_count(*[C(c) for c in span]).alias("missing"))


@query(
    """SELECT doc_id, lang, source FROM documents WHERE regexp_matches(text, 'malig|carci|transf|cancer|dysplas|the')
    OR regexp_matches(lang, 'malig|carci|transf|cancer|dysplas|the') OR regexp_matches(source, 'malig|carci|transf|cancer|dysplas|the')
    OR regexp_matches(n_chars::VARCHAR, 'malig|carci|transf|cancer|dysplas|the')"""
)
def any_column_match(spark, d):
    docs = table(spark, d, "documents")
    hit = recoding.any_matches([C(c) for c in ("text", "lang", "source", "n_chars")], "malig|carci|transf|cancer|dysplas|the")
    return docs.filter(hit).select("doc_id", "lang", "source")


@query(
    f"""WITH a AS (SELECT c_custkey, {round_sql('c_acctbal / 100', 1)} AS age FROM customer)
    SELECT c_custkey, CASE WHEN age <= 18 THEN 'child' ELSE 'adult' END AS age_class,
    CASE WHEN age > -1 AND age <= 0.5 THEN 'none' WHEN age > 0.5 AND age <= 2.5 THEN 'one or two'
    WHEN age > 2.5 AND age <= 44 THEN 'several or lots' END AS calls_class FROM a"""
)
def bin_labels(spark, d):
    age = numbers.round_even(C("c_acctbal") / 100, 1)
    return table(spark, d, "customer").select(
        "c_custkey",
        numbers.bin_label(age, [float("-inf"), 18.0, float("inf")], ["child", "adult"]).alias("age_class"),
        numbers.bin_label(age, [-1, 0.5, 2.5, 44], ["none", "one or two", "several or lots"]).alias("calls_class"),
    )


@query(
    f"""WITH {LOG_CTE} SELECT subject_code, CASE WHEN surg_life IS NULL THEN NULL WHEN surg_life >= 10 THEN 'aggr' ELSE 'indolent' END AS course
    FROM patient_log"""
)
def if_else_null(spark, d):
    course = numbers.if_else(C("surg_life") >= 10, F.lit("aggr"), F.lit("indolent"))
    return patient_log(spark, d).select("subject_code", course.alias("course"))


@query(
    """SELECT o_orderkey, o_totalprice::VARCHAR IS NOT NULL AS printed, TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority_number,
    TRY_CAST(substr(o_orderpriority, 3, 3) AS INT) AS not_a_number, o_custkey::DOUBLE AS cust_double FROM orders"""
)
def cast_columns(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        C("o_totalprice").cast("string").isNotNull().alias("printed"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("priority_number"),
        F.substring("o_orderpriority", 3, 3).try_cast("int").alias("not_a_number"),
        C("o_custkey").cast("double").alias("cust_double"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity >= 30 AND l_discount < 0.05)
    OR (l_returnflag = 'R' AND l_tax > 0.06)"""
)
def filter_compound(spark, d):
    wanted = ((C("l_quantity") >= 30) & (C("l_discount") < 0.05)) | ((C("l_returnflag") == "R") & (C("l_tax") > 0.06))
    return table(spark, d, "lineitem").filter(wanted).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    """SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^(RED|small)') AND NOT regexp_matches(p_name, 'ring$|bolt$')"""
)
def regex_filter(spark, d):
    name = C("p_name")
    return table(spark, d, "part").filter(name.rlike("(?i)^(RED|small)") & ~name.rlike("ring$|bolt$")).select("p_partkey", "p_name")


@query(
    f"""WITH {LOG_CTE} SELECT subject_code FROM patient_log WHERE surg_12m IS NULL AND surg_max_12m IS NULL
    UNION ALL SELECT subject_code FROM patient_log WHERE sex IS NOT NULL AND race IS NOT NULL AND dob IS NOT NULL AND surg_life IS NOT NULL
    AND type IS NOT NULL"""
)
def all_null_rows(spark, d):
    log = patient_log(spark, d)
    nothing = log.filter(C("surg_12m").isNull() & C("surg_max_12m").isNull())
    everything = log.dropna(subset=["sex", "race", "dob", "surg_life", "type"])
    return nothing.select("subject_code").unionByName(everything.select("subject_code"))


@query(
    f"""WITH s AS (SELECT c_custkey, {code_sql('c_custkey')} AS subject_code FROM customer)
    SELECT subject_code, substr(subject_code, 1, 8) AS family,
    CASE WHEN substr(subject_code, 9) LIKE 'S%' THEN 'SI' ELSE substr(subject_code, 9) END AS relationship,
    substr(subject_code, 1, 8) || 'PT' AS patient_code,
    CASE WHEN regexp_matches(substr(subject_code, 9), '^S[0-9]{{6}}$')
      THEN make_date(substr(subject_code, 10, 4)::BIGINT, substr(subject_code, 14, 2)::BIGINT, 15::BIGINT) END AS birth FROM s"""
)
def parse_code(spark, d):
    code = C("subject_code")
    return table(spark, d, "customer").select(subject_code(C("c_custkey")).alias("subject_code")).select(
        "subject_code",
        codes.family_of(code).alias("family"),
        codes.relationship_of(code).alias("relationship"),
        codes.patient_code(codes.family_of(code)).alias("patient_code"),
        codes.sibling_birth_date(code).alias("birth"),
    )


_STUDY = f"""study AS (SELECT CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN replace({code_sql('o_custkey')}, '0', 'O')
  ELSE {code_sql('o_custkey')} END AS subject_code,
  CASE WHEN o_totalprice < 20000 THEN 'GUEST' WHEN o_custkey % 4 = 0 THEN 'MAIN' ELSE 'MAIN-REL' END AS study_code FROM orders)"""


def study_codes(spark, d):
    code = subject_code(C("o_custkey"))
    miskeyed = (C("o_orderstatus") == "P") & (C("o_totalprice") > 450000)
    return table(spark, d, "orders").select(
        F.when(miskeyed, F.replace(code, F.lit("0"), F.lit("O"))).otherwise(code).alias("subject_code"),
        F.when(C("o_totalprice") < 20000, "GUEST").when(F.pmod("o_custkey", F.lit(4)) == 0, "MAIN").otherwise("MAIN-REL").alias("study_code"),
    )


@query(
    f"""WITH {_STUDY} SELECT regexp_matches(subject_code, '^[A-Za-z]{{3}}[0-9]{{5}}[A-Za-z]') AS well_formed,
    study_code, count(*) AS n FROM study GROUP BY ALL"""
)
def code_pattern_check(spark, d):
    checked = study_codes(spark, d).withColumn("well_formed", codes.is_well_formed(C("subject_code")))
    return checked.groupBy("well_formed", "study_code").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, DATE '1899-12-30' + (34000 + (l_partkey % 4000))::INT AS extract_date,
    DATE '1899-12-30' + floor(34000 + l_extendedprice / 50)::INT AS spectro_date FROM lineitem"""
)
def excel_date(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        dates.from_serial(34000 + F.pmod("l_partkey", F.lit(4000))).alias("extract_date"),
        dates.from_serial(34000 + C("l_extendedprice") / 50).alias("spectro_date"),
    )


@query(
    f"""WITH p AS (SELECT c_custkey, {cents_sql('c_acctbal')} AS c FROM customer),
    q AS (SELECT c_custkey, CASE WHEN c % 19 = 0 THEN 9999 ELSE 1980 + c % 30 END AS y, CASE WHEN c % 7 = 0 THEN 99 ELSE 1 + c % 12 END AS m FROM p)
    SELECT c_custkey, CASE WHEN y = 9999 THEN NULL ELSE make_date(y::BIGINT, (CASE WHEN m = 99 THEN 6 ELSE m END)::BIGINT, 15::BIGINT) END AS dx_date,
    CASE WHEN y <> 9999 AND m <= 12 THEN make_date(y::BIGINT, m::BIGINT, 1::BIGINT) END AS parsed FROM q"""
)
def partial_date(spark, d):
    c = cents(C("c_acctbal"))
    year = F.when(F.pmod(c, F.lit(19)) == 0, 9999).otherwise(1980 + F.pmod(c, F.lit(30)))
    month = F.when(F.pmod(c, F.lit(7)) == 0, 99).otherwise(1 + F.pmod(c, F.lit(12)))
    known_year = recoding.without_sentinel(year, "9999")
    text = F.concat_ws("-", known_year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit("01"))
    return table(spark, d, "customer").select(
        "c_custkey",
        dates.partial_date(known_year, recoding.without_sentinel(month, "99")).alias("dx_date"),
        dates.parse_date(text).alias("parsed"),
    )


@query("SELECT event_id, ts::DATE AS day, strftime(ts, '%H:%M:%S') AS time_of_day FROM events")
def split_timestamp(spark, d):
    return table(spark, d, "events").select("event_id", dates.date_part(C("ts")).alias("day"), dates.time_part(C("ts")).alias("time_of_day"))


@query(
    f"""WITH {LOG_CTE} SELECT subject_code, mother_dob + floor((mother_debut_age + 0.5::DOUBLE) * 365.25::DOUBLE)::INT AS debut_date
    FROM patient_log"""
)
def date_shift(spark, d):
    return patient_log(spark, d).select(
        "subject_code", dates.shift_years(C("mother_dob"), C("mother_debut_age") + F.lit(0.5)).alias("debut_date")
    )


@query(
    f"""WITH {SPECIMENS_CTE} SELECT specimen_id, 'received_before_collected' AS problem, date_diff('day', collect_date, recd_date)::INT AS days
    FROM specimens WHERE recd_date < collect_date
    UNION ALL SELECT specimen_id, 'born_after_collection', date_diff('day', collect_date, subj_dob)::INT FROM specimens WHERE subj_dob > collect_date"""
)
def date_order_violations(spark, d):
    all_specimens = specimens(spark, d)
    early = all_specimens.filter(C("recd_date") < C("collect_date")).select(
        "specimen_id", F.lit("received_before_collected").alias("problem"), F.datediff("recd_date", "collect_date").alias("days")
    )
    unborn = all_specimens.filter(C("subj_dob") > C("collect_date")).select(
        "specimen_id", F.lit("born_after_collection").alias("problem"), F.datediff("subj_dob", "collect_date").alias("days")
    )
    return early.unionByName(unborn)


@query(
    f"""WITH {STOCKS_CTE} SELECT specimen_id, {round_sql('ln(yield_ug)', 6)} AS ln_yield, {round_sql('log2(yield_ug)', 6)} AS log2_yield,
    {round_sql('log10(yield_ug)', 6)} AS log10_yield, {round_sql('pow(ratio_low + 0.1::DOUBLE, 3)', 6)} AS cubed FROM stocks WHERE yield_ug > 0"""
)
def math_scores(spark, d):
    known = stocks(spark, d).filter(C("yield_ug") > 0)
    r = lambda x: numbers.round_even(x, 6)
    return known.select(
        "specimen_id",
        r(F.ln("yield_ug")).alias("ln_yield"),
        r(F.log2("yield_ug")).alias("log2_yield"),
        r(F.log10("yield_ug")).alias("log10_yield"),
        r(F.pow(C("ratio_low") + 0.1, F.lit(3.0))).alias("cubed"),
    )


@query(
    f"""SELECT l_orderkey, l_linenumber, {signif_sql('l_extendedprice', 2)} AS price_2, {signif_sql('l_discount', 1)} AS discount_1,
    round_even(l_quantity / 4, 0) AS quarter, ceil(l_quantity / 95)::BIGINT AS plates FROM lineitem"""
)
def signif_round(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        numbers.signif(C("l_extendedprice"), 2).alias("price_2"),
        numbers.signif(C("l_discount"), 1).alias("discount_1"),
        numbers.round_even(C("l_quantity") / 4).alias("quarter"),
        F.ceil(C("l_quantity") / 95).alias("plates"),
    )


@query("SELECT p_partkey, (1 + p_size % 9) / 10.0::DOUBLE AS share_first, 1.0::DOUBLE - (1 + p_size % 9) / 10.0::DOUBLE AS share_second FROM part")
def mixing_table(spark, d):
    first, second = numbers.mixing_shares(1 + F.pmod("p_size", F.lit(9)))
    return table(spark, d, "part").select("p_partkey", first.alias("share_first"), second.alias("share_second"))


@query(
    """SELECT doc_id, regexp_extract(text, '[A-Z][a-z]+') AS token FROM documents WHERE regexp_extract(text, '[A-Z][a-z]+') <> ''"""
)
def extract_tokens(spark, d):
    found = table(spark, d, "documents").select("doc_id", codes.first_match(C("text"), "[A-Z][a-z]+").alias("token"))
    return found.filter(C("token").isNotNull())


@query(
    f"""WITH {SPECIMENS_CTE}, {UPDATES_CTE}, w AS (
      SELECT specimen_id, CASE WHEN tissue = 'BUC' THEN 'MW' ELSE tissue END AS tissue, subject_code, collect_date, recd_date FROM specimens
      WHERE subject_code NOT LIKE 'AAA%'),
    f AS (SELECT specimen_id, CASE WHEN tissue = 'MW' AND collect_date IS NULL THEN 'LRNXP' ELSE tissue END AS tissue, subject_code,
      CASE WHEN collect_date IS NULL THEN recd_date ELSE collect_date END AS collect_date FROM w)
    SELECT f.specimen_id, CASE WHEN x.event_id IS NOT NULL THEN x.event_type ELSE f.tissue END AS tissue,
      f.subject_code, f.collect_date FROM f LEFT JOIN events x ON f.specimen_id = x.event_id AND x.event_type = 'error'"""
)
def clean_rules(spark, d):
    """Withdrawn families out, ordered rules, then a corrections table (last correction per cell wins)."""
    from kinsieve.operators.ordered import asc
    from kinsieve.operators.rules import apply_corrections
    from kinsieve.plans.report import without_prefixes

    kept = without_prefixes(specimens(spark, d), ["AAA"]).select("specimen_id", "tissue", "subject_code", "collect_date", "recd_date")
    ruled = apply_rules(
        kept,
        [
            Rule("tissue", C("tissue") == "BUC", "MW"),
            Rule("tissue", (C("tissue") == "MW") & C("collect_date").isNull(), "LRNXP"),
            Rule("collect_date", C("collect_date").isNull(), C("recd_date")),
        ],
    ).drop("recd_date")
    corrections = table(spark, d, "events").filter(C("event_type") == "error").select(
        C("event_id").alias("specimen_id"), F.lit("tissue").alias("column_name"), C("event_type").alias("new_value"), "ts"
    )
    return apply_corrections(ruled, corrections, "specimen_id", ["tissue"], [asc("ts")], hot=[])
