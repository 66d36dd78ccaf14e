"""The given tables read as a family-based collection, in Spark and, for the oracle, in SQL.

Customers are subjects (four to a family: patient, father, mother, sibling), orders are specimens, line
items are stock measurements, events are clinical updates. Gaps and contradictions are planted by
arithmetic on the cents of an amount, the same way in both dialects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinsieve.functions import codes
from kinsieve.functions.dates import partial_date
from kinsieve.functions.recoding import without_sentinel
from kinsieve.operators.joins import first_per_key
from kinsieve.operators.ordered import desc
from kinsieve.plans.selection import stock_measures
from kinsieve.sources.tables import read_parquet_table

EDU_LEVELS = ("Grade9", "Grade12", "HighSchool", "CollegeSome", "AssociateDeg", "Bachelor", "Graduate")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet_table(spark, folder, name)


def subject_code(key: Column) -> Column:
    """Unique for the first 1.7 billion families, all that three letters and five digits can tell apart."""
    over = lambda x, by: F.call_function("div", x, F.lit(by))
    family = over(key.cast("long"), 4)
    number = F.pmod(family, F.lit(100000))
    prefix = F.pmod(number + over(family, 100000), F.lit(17576))
    letters = [F.char(F.lit(65) + F.pmod(over(prefix, step), F.lit(26))) for step in (1, 26, 676)]
    digits = F.lpad(number.cast("string"), 5, "0")
    birth = F.concat(
        F.lit("S"),
        (F.lit(1990) + F.pmod(family, F.lit(20))).cast("string"),
        F.lpad((F.pmod(family, F.lit(12)) + 1).cast("string"), 2, "0"),
    )
    role = F.pmod(key, F.lit(4))
    suffix = (
        F.when(role == 0, "PT").when(role == 1, "FA").when(role == 2, "MO").when(family % 3 == 0, birth).otherwise("S1")
    )
    return F.concat(*letters, digits, suffix)


def code_sql(key: str) -> str:
    fam = f"({key} // 4)"
    prefix = f"(({fam} % 100000 + {fam} // 100000) % 17576)"
    return (
        f"(chr((65 + {prefix} % 26)::INT) || chr((65 + ({prefix} // 26) % 26)::INT) || chr((65 + ({prefix} // 676) % 26)::INT)"
        f" || lpad(({fam} % 100000)::VARCHAR, 5, '0') || CASE {key} % 4 WHEN 0 THEN 'PT' WHEN 1 THEN 'FA'"
        f" WHEN 2 THEN 'MO' ELSE CASE WHEN {fam} % 3 = 0 THEN 'S' || (1990 + {fam} % 20)::VARCHAR"
        f" || lpad(({fam} % 12 + 1)::VARCHAR, 2, '0') ELSE 'S1' END END)"
    )


def cents(amount: Column) -> Column:
    return F.rint(F.abs(amount) * 100).cast("long")


def cents_sql(amount: str) -> str:
    return f"round_even(abs({amount}) * 100, 0)::BIGINT"


def days_after(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


# -- patient log: one row per patient ------------------------------------------------------------


def patient_log(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("cents")
    coded = table(spark, folder, "customer").select(
        subject_code(F.col("c_custkey")).alias("subject_code"), "c_mktsegment", cents(F.col("c_acctbal")).alias("cents")
    )
    raw = coded.filter(codes.suffix_of(F.col("subject_code")) == codes.PATIENT)
    m = lambda k: F.pmod(c, F.lit(k))
    half = F.floor(c / 7)
    h = lambda k: F.pmod(half, F.lit(k))
    year = without_sentinel(F.when(m(19) == 0, 9999).otherwise(1995 + m(6)), "9999")
    month = without_sentinel(F.when(m(7) == 0, 99).otherwise(1 + m(12)), "99")
    return raw.select(
        "subject_code",
        F.col("c_mktsegment").alias("site_code"),
        F.when(m(17) != 0, F.when(m(2) == 0, "Female").otherwise("Male")).alias("sex"),
        F.when(m(11) != 0, F.get(F.array(*[F.lit(v) for v in ("White", "Black", "Asian", "Other")]), h(4).cast("int"))).alias("race"),
        F.when(h(9) != 0, F.when(h(3) == 0, "Hispanic").otherwise("Not Hispanic")).alias("ethnicity"),
        F.when(m(13) != 0, days_after("1975-01-01", m(7300))).alias("dob"),
        F.when(h(10) != 0, days_after("1999-01-01", h(900))).alias("spec_date"),
        partial_date(year, month).alias("dx_date"),
        F.when(h(5) != 0, days_after("1950-01-15", h(7000))).alias("mother_dob"),
        (14 + h(12)).alias("mother_debut_age"),
        F.when(h(3) == 0, "Currently present").when(h(3) == 1, "Never").when(h(6) == 2, "Used to have").alias("trach_log"),
        F.when(m(4) != 0, F.when(m(5) == 0, 1).otherwise(0)).alias("site_pulmonary"),
        F.when(h(4) != 0, F.when(h(7) == 0, 1).otherwise(0)).alias("site_bronchus"),
        F.when(m(9) != 0, F.lit(0)).alias("site_trachea"),
        F.when(m(8) != 0, m(30)).alias("surg_life"),
        F.when(h(6) != 0, h(7)).alias("surg_12m"),
        F.when(h(8) != 0, h(9)).alias("surg_max_12m"),
        F.when(m(5) > 1, F.when(m(5) == 2, "hybrid intervals").otherwise("prn intervals")).alias("surg_style"),
        F.when(h(11) > 3, F.get(F.array(*[F.lit(v) for v in ("6", "11", "16", "611", "retest", "6", "11", "unclear")]), h(8).cast("int"))).alias("type"),
    )


LOG_CTE = f"""log_raw AS (
  SELECT {code_sql('c_custkey')} AS subject_code, c_mktsegment, {cents_sql('c_acctbal')} AS c FROM customer),
log0 AS (SELECT *, c // 7 AS h,
  CASE WHEN c % 19 <> 0 THEN 1995 + c % 6 END AS year_dx, CASE WHEN c % 7 = 0 THEN NULL ELSE 1 + c % 12 END AS month_dx
  FROM log_raw WHERE substr(subject_code, 9) = 'PT'),
patient_log AS (SELECT subject_code, c_mktsegment AS site_code,
  CASE WHEN c % 17 <> 0 THEN CASE WHEN c % 2 = 0 THEN 'Female' ELSE 'Male' END END AS sex,
  CASE WHEN c % 11 <> 0 THEN list_extract(['White','Black','Asian','Other'], (h % 4 + 1)::BIGINT) END AS race,
  CASE WHEN h % 9 <> 0 THEN CASE WHEN h % 3 = 0 THEN 'Hispanic' ELSE 'Not Hispanic' END END AS ethnicity,
  CASE WHEN c % 13 <> 0 THEN DATE '1975-01-01' + (c % 7300)::INT END AS dob,
  CASE WHEN h % 10 <> 0 THEN DATE '1999-01-01' + (h % 900)::INT END AS spec_date,
  make_date(year_dx::BIGINT, coalesce(month_dx, 6)::BIGINT, 15::BIGINT) AS dx_date,
  CASE WHEN h % 5 <> 0 THEN DATE '1950-01-15' + (h % 7000)::INT END AS mother_dob,
  14 + h % 12 AS mother_debut_age,
  CASE WHEN h % 3 = 0 THEN 'Currently present' WHEN h % 3 = 1 THEN 'Never' WHEN h % 6 = 2 THEN 'Used to have' END AS trach_log,
  CASE WHEN c % 4 <> 0 THEN CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END END AS site_pulmonary,
  CASE WHEN h % 4 <> 0 THEN CASE WHEN h % 7 = 0 THEN 1 ELSE 0 END END AS site_bronchus,
  CASE WHEN c % 9 <> 0 THEN 0 END AS site_trachea,
  CASE WHEN c % 8 <> 0 THEN c % 30 END AS surg_life,
  CASE WHEN h % 6 <> 0 THEN h % 7 END AS surg_12m,
  CASE WHEN h % 8 <> 0 THEN h % 9 END AS surg_max_12m,
  CASE WHEN c % 5 > 1 THEN CASE WHEN c % 5 = 2 THEN 'hybrid intervals' ELSE 'prn intervals' END END AS surg_style,
  CASE WHEN h % 11 > 3 THEN list_extract(['6','11','16','611','retest','6','11','unclear'], (h % 8 + 1)::BIGINT) END AS type
  FROM log0)"""


# -- clinical updates: one row per event ---------------------------------------------------------


def clinical_updates(spark: SparkSession, folder: str, latest: bool = False) -> DataFrame:
    """All updates, or the latest of each patient: cut down before codes and dates are derived, as rows are sorted for that."""
    c = cents(F.col("value"))
    kind = F.col("event_type")
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")
    if latest:
        events = first_per_key(events, ["user_id"], [desc("event_id")])
    return events.select(
        subject_code(F.col("user_id") * 4).alias("subject_code"),
        F.col("event_id").alias("update_id"),
        F.date_sub(F.to_date("ts"), F.lit(8000)).alias("update_date"),
        F.when(kind == "click", "Never").when(kind == "error", "Currently present").when(kind == "view", "Used to have").alias("trach_upd"),
        F.when(kind != "signup", F.pmod(c, F.lit(40))).alias("surg_life_upd"),
        F.when(kind != "purchase", F.pmod(c, F.lit(6))).alias("surg_12m_upd"),
        F.when(F.pmod(c, F.lit(3)) != 0, F.pmod(c, F.lit(2))).alias("ever_distal"),
        F.when(F.pmod(c, F.lit(5)) == 0, "Not Recorded").when(F.pmod(c, F.lit(5)) == 1, "No").when(F.pmod(c, F.lit(5)) == 2, "Yes, lungs").when(F.pmod(c, F.lit(5)) == 3, "Unsure").alias("below_voice_box"),
    )


UPDATES_CTE = f"""updates AS (SELECT {code_sql('(user_id * 4)')} AS subject_code, event_id AS update_id,
  (ts::DATE - 8000)::DATE AS update_date,
  CASE event_type WHEN 'click' THEN 'Never' WHEN 'error' THEN 'Currently present' WHEN 'view' THEN 'Used to have' END AS trach_upd,
  CASE WHEN event_type <> 'signup' THEN {cents_sql('value')} % 40 END AS surg_life_upd,
  CASE WHEN event_type <> 'purchase' THEN {cents_sql('value')} % 6 END AS surg_12m_upd,
  CASE WHEN {cents_sql('value')} % 3 <> 0 THEN {cents_sql('value')} % 2 END AS ever_distal,
  CASE {cents_sql('value')} % 5 WHEN 0 THEN 'Not Recorded' WHEN 1 THEN 'No' WHEN 2 THEN 'Yes, lungs' WHEN 3 THEN 'Unsure' END AS below_voice_box
  FROM events)"""


# -- specimens: one row per order ----------------------------------------------------------------


def specimens(spark: SparkSession, folder: str) -> DataFrame:
    c = cents(F.col("o_totalprice"))
    m = lambda k: F.pmod(c, F.lit(k))
    day = F.to_date("o_orderdate")
    role = F.pmod("o_custkey", F.lit(4))
    right = F.when(role == 1, "M").when(role == 2, "F").when(F.pmod("o_custkey", F.lit(8)) < 4, "M").otherwise("F")
    wrong = F.when(right == "M", "F").otherwise("M")
    priority = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("specimen_id"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderkey") - F.when(F.col("o_totalprice") > 490000, 1).otherwise(0)).alias("stock_id"),
        subject_code(F.col("o_custkey")).alias("subject_code"),
        F.when(priority == "2-HIGH", "MW").when(priority == "3-MEDIUM", "LRNXP").when(priority == "4-NOT SPECIFIED", "BUC").otherwise("WB").alias("tissue"),
        F.when(m(9) != 0, day).alias("collect_date"),
        F.when(m(10) != 0, F.date_add(day, (m(12) - 2).cast("int"))).alias("recd_date"),
        F.date_add(day, 20).alias("keyed_date"),
        F.when(m(97) == 0, wrong).otherwise(right).alias("subj_sex"),
        F.when(role != 0, days_after("1950-01-01", F.pmod(F.col("o_custkey") * 7919, F.lit(18000)))).alias("subj_dob"),
    )


SPECIMENS_CTE = f"""spec0 AS (SELECT *, {cents_sql('o_totalprice')} AS c, o_orderdate::DATE AS d,
  CASE WHEN o_custkey % 4 = 1 THEN 'M' WHEN o_custkey % 4 = 2 THEN 'F' WHEN o_custkey % 8 < 4 THEN 'M' ELSE 'F' END AS rs
  FROM orders),
specimens AS (SELECT o_orderkey AS specimen_id, o_orderstatus AS status,
  o_orderkey - CASE WHEN o_totalprice > 490000 THEN 1 ELSE 0 END AS stock_id,
  {code_sql('o_custkey')} AS subject_code,
  CASE o_orderpriority WHEN '2-HIGH' THEN 'MW' WHEN '3-MEDIUM' THEN 'LRNXP' WHEN '4-NOT SPECIFIED' THEN 'BUC' ELSE 'WB' END AS tissue,
  CASE WHEN c % 9 <> 0 THEN d END AS collect_date,
  CASE WHEN c % 10 <> 0 THEN d + (c % 12 - 2)::INT END AS recd_date,
  d + 20 AS keyed_date,
  CASE WHEN c % 97 = 0 THEN CASE WHEN rs = 'M' THEN 'F' ELSE 'M' END ELSE rs END AS subj_sex,
  CASE WHEN o_custkey % 4 <> 0 THEN DATE '1950-01-01' + ((o_custkey * 7919) % 18000)::INT END AS subj_dob
  FROM spec0)"""


BY_SPECIMEN_CTE = f"""{LOG_CTE}, {SPECIMENS_CTE},
by_specimen AS (SELECT s.*, l.sex, l.race, l.ethnicity, l.dob, l.spec_date,
  substr(s.subject_code, 1, 8) AS family,
  CASE WHEN substr(s.subject_code, 9) LIKE 'S%' THEN 'SI' ELSE substr(s.subject_code, 9) END AS relationship,
  least(l.spec_date, s.collect_date, s.recd_date, s.keyed_date) AS enroll_date
  FROM specimens s LEFT JOIN patient_log l ON s.subject_code = l.subject_code)"""


# -- stocks: measurements per specimen -----------------------------------------------------------


def stocks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with line items. A few aggregates per order, combined before the shuffle."""
    lines = table(spark, folder, "lineitem")
    measured = lines.groupBy(F.col("l_orderkey").alias("specimen_id")).agg(
        (F.max("l_extendedprice") / 500).alias("conc"),
        (F.sum("l_quantity") - 20).alias("volume"),
        (F.lit(1.5) + F.max("l_discount") * 5).alias("abs_ratio"),
        F.to_date(F.min("l_shipdate")).alias("extract_date"),
    )
    return stock_measures(measured)


STOCKS_CTE = """stocks0 AS (SELECT l_orderkey AS specimen_id, max(l_extendedprice) / 500 AS conc, sum(l_quantity) - 20 AS volume,
  1.5::DOUBLE + max(l_discount) * 5 AS abs_ratio, min(l_shipdate)::DATE AS extract_date FROM lineitem GROUP BY 1),
stocks AS (SELECT *, CASE WHEN abs_ratio > 1.8::DOUBLE THEN 0.0::DOUBLE ELSE 1.8::DOUBLE - abs_ratio END AS ratio_low,
  conc * volume * 0.001::DOUBLE AS yield_ug FROM stocks0)"""


def signif_sql(x: str, digits: int) -> str:
    """SQL counterpart of `signif`."""
    shift = f"({digits - 1} - floor(log10(abs({x}))))"
    return (
        f"(CASE WHEN {x} = 0 THEN 0.0 WHEN {x} IS NULL THEN NULL WHEN {shift} >= 0"
        f" THEN round_even(({x}) * pow(10.0::DOUBLE, {shift}), 0) / pow(10.0::DOUBLE, {shift})"
        f" ELSE round_even(({x}) / pow(10.0::DOUBLE, -{shift}), 0) * pow(10.0::DOUBLE, -{shift}) END)"
    )


def round_sql(x: str, digits: int) -> str:
    """SQL counterpart of `round_even`."""
    if digits == 0:
        return f"round_even(({x})::DOUBLE, 0)"
    return f"(round_even(({x})::DOUBLE * {10**digits}.0::DOUBLE, 0) / {10**digits}.0::DOUBLE)"


def uniform_sql(seed: int, key: str) -> str:
    """SQL counterpart of `uniform`."""
    return f"((('0x' || substr(md5('{seed}|' || ({key})::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def family_sql(code: str) -> str:
    return f"substr({code}, 1, {codes.FAMILY_LENGTH})"
