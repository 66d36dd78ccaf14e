"""The composite plans over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsieve.catalog import query
from kinsieve.catalog.standins import (
    BY_SPECIMEN_CTE,
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
    uniform_sql,
)
from kinsieve.catalog.columns import _STUDY, study_codes
from kinsieve.functions import codes
from kinsieve.functions.numbers import round_even, signif
from kinsieve.operators.joins import salted_join
from kinsieve.operators.sampling import sample_n
from kinsieve.plans import cohort, integrity, plates, report, selection
from kinsieve.session import shared

C = F.col

# The lists a user would supply.
MULTIPLEX = ("AAA00000PT", "AAA00000FA", "AAA00000MO", "BAA00001PT", "BAA00001MO", "CAA00002PT")
EXCLUDED_FAMILIES = ("DAA00003", "EAA00004")
ADULT_FAMILIES = ("FAA00005",)
GERMLINE = ("BUC", "MW", "WB")
SEED = 2015


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _rounded(df, digits, *names):
    return df.withColumns({n: round_even(C(n), digits) for n in names})


# -- typing ---------------------------------------------------------------------------------------

_TYPES = "['6','11','16','611','retest']"
_TYPING_CTE = f"""{SPECIMENS_CTE}, {LOG_CTE},
typing AS (SELECT subject_code, stock_id, CASE WHEN specimen_id % 6 < 5 THEN list_extract({_TYPES}, (specimen_id % 6 + 1)::BIGINT) END AS type, 1 AS priority, 'clustered' AS source
    FROM specimens WHERE tissue = 'LRNXP' AND substr(subject_code, 9) = 'PT' AND status = 'F'
  UNION ALL SELECT subject_code, stock_id, list_extract({_TYPES}, (stock_id % 3 + 1)::BIGINT), 2, 'early' FROM specimens
    WHERE tissue = 'BUC' AND substr(subject_code, 9) = 'PT' AND status = 'O' AND stock_id >= 0
  UNION ALL SELECT subject_code, NULL, type, 3, 'provided' FROM patient_log WHERE type IS NOT NULL),
typed_once AS (SELECT subject_code, stock_id, type, priority, source FROM (SELECT *, row_number() OVER (PARTITION BY subject_code
    ORDER BY priority, stock_id NULLS FIRST, type NULLS FIRST) AS i FROM typing) WHERE i = 1)"""


def typing_sources(spark, d):
    def pick(number):
        return F.get(F.array(*[F.lit(v) for v in cohort.TYPE_LEVELS]), number.cast("int"))

    mine = specimens(spark, d).filter(codes.suffix_of(C("subject_code")) == codes.PATIENT)
    clustered = mine.filter((C("tissue") == "LRNXP") & (C("status") == "F")).select(
        "subject_code", "stock_id", pick(F.pmod("specimen_id", F.lit(6))).alias("type")
    )
    early = mine.filter((C("tissue") == "BUC") & (C("status") == "O") & (C("stock_id") >= 0)).select(
        "subject_code", "stock_id", pick(F.pmod("stock_id", F.lit(3))).alias("type")
    )
    provided = patient_log(spark, d).filter(C("type").isNotNull()).select("subject_code", "type")
    return {"clustered": clustered, "early": early, "provided": provided}


@query(
    f"""WITH {_TYPING_CTE} SELECT l.subject_code, t.source, CASE WHEN t.type IN ('6','11','16','611','retest') THEN t.type END AS type
    FROM patient_log l LEFT JOIN typed_once t ON l.subject_code = t.subject_code"""
)
def merge_typing_sources(spark, d):
    once = cohort.typing_once(cohort.stack_typing(typing_sources(spark, d)))
    patients = patient_log(spark, d).select("subject_code")
    typed = cohort.add_typing(patients, once)
    return typed.join(once.select("subject_code", "source"), "subject_code", "left")


@query(
    f"""WITH {_TYPING_CTE}, again AS (SELECT subject_code FROM typing GROUP BY 1 HAVING count(*) > 1)
    SELECT subject_code, stock_id, min(type) FILTER (source = 'clustered') AS clustered, min(type) FILTER (source = 'early') AS early,
    min(type) FILTER (source = 'provided') AS provided FROM typing WHERE subject_code IN (SELECT * FROM again) GROUP BY 1, 2"""
)
def typing_repeats(spark, d):
    sources = typing_sources(spark, d)
    return cohort.typing_repeats(cohort.stack_typing(sources), list(sources))


@query(
    f"""WITH {_TYPING_CTE}, t AS (SELECT * FROM typing)
    SELECT stock_id, subject_code, 'unclear' AS reason FROM t WHERE type IS NULL OR type NOT IN ('6', '11')
    UNION ALL SELECT stock_id, subject_code, 'never typed' FROM specimens s WHERE tissue = 'LRNXP'
      AND NOT EXISTS (SELECT 1 FROM t WHERE t.stock_id = s.stock_id)"""
)
def retest_worklist(spark, d):
    stacked = cohort.stack_typing(typing_sources(spark, d))
    return selection.retest_worklist(stacked, specimens(spark, d), ["6", "11"])


# -- person view and clinical summary -------------------------------------------------------------

_PEOPLE_CTE = f"""{BY_SPECIMEN_CTE},
p0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_code ORDER BY enroll_date NULLS FIRST, stock_id NULLS FIRST, specimen_id) AS i
  FROM by_specimen) WHERE i = 1),
p1 AS (SELECT * EXCLUDE (dob), substr(subject_code, 9) AS suffix, coalesce(dob, subj_dob, CASE WHEN regexp_matches(substr(subject_code, 9), '^S[0-9]{{6}}$')
  THEN make_date(substr(subject_code, 10, 4)::BIGINT, substr(subject_code, 14, 2)::BIGINT, 15::BIGINT) END) AS dob FROM p0),
p2 AS (SELECT *, {round_sql("date_diff('day', dob, least(spec_date, recd_date, collect_date)) / 365.25", 1)} AS age FROM p1),
p3 AS (SELECT *, CASE WHEN suffix IN ('FA','MO','MGM','MGF') OR family IN ({_listed(ADULT_FAMILIES)}) THEN 'adult' WHEN age <= 18 THEN 'child' WHEN age > 18 THEN 'adult' END AS c0 FROM p2),
people AS (SELECT p.subject_code, p.family, p.relationship,
  CASE WHEN p.sex IS NULL AND p.subj_sex = 'F' THEN 'Female' WHEN p.sex IS NULL AND p.subj_sex = 'M' THEN 'Male' ELSE p.sex END AS sex,
  coalesce(last_value(p.race IGNORE NULLS) OVER (PARTITION BY p.family ORDER BY p.subject_code ROWS UNBOUNDED PRECEDING),
    first_value(p.race IGNORE NULLS) OVER (PARTITION BY p.family ORDER BY p.subject_code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS race,
  coalesce(last_value(p.ethnicity IGNORE NULLS) OVER (PARTITION BY p.family ORDER BY p.subject_code ROWS UNBOUNDED PRECEDING),
    first_value(p.ethnicity IGNORE NULLS) OVER (PARTITION BY p.family ORDER BY p.subject_code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ethnicity,
  p.dob, p.enroll_date, p.age, CASE WHEN p.suffix LIKE 'S%' AND p.c0 IS NULL THEN q.c0 ELSE p.c0 END AS age_class
  FROM p3 p LEFT JOIN p3 q ON p.family = q.family AND q.suffix = 'PT')"""


def people_of(spark, d):
    return cohort.person_view(cohort.specimen_view(patient_log(spark, d), specimens(spark, d)), ADULT_FAMILIES)


@query(f"WITH {_PEOPLE_CTE} SELECT * FROM people")
def person_view(spark, d):
    return people_of(spark, d)


@query(
    f"""WITH {_PEOPLE_CTE}, l AS (SELECT g.*, p.enroll_date, g.mother_dob + floor((g.mother_debut_age + 0.5::DOUBLE) * 365.25::DOUBLE)::INT AS debut
      FROM patient_log g LEFT JOIN people p ON g.subject_code = p.subject_code)
    SELECT subject_code, {round_sql("date_diff('day', dob, dx_date) / 365.25", 2)} AS dx_age,
    {round_sql("date_diff('day', dob, enroll_date) / 365.25", 2)} AS enroll_age,
    {round_sql("date_diff('day', mother_dob, dob) / 365.25", 2)} AS mother_age,
    {round_sql("date_diff('day', debut, dob) / 365.25", 2)} AS debut_to_birth,
    CASE WHEN {round_sql("date_diff('day', dob, dx_date) / 365.25", 2)} >= 18 THEN 'adult'
      WHEN dob IS NOT NULL AND dx_date IS NOT NULL THEN 'child' END AS onset FROM l"""
)
def duration_years(spark, d):
    """Ages of the patients, at enrolment by the date that the person view has."""
    log = cohort.with_enrolment(patient_log(spark, d), people_of(spark, d))
    return cohort.life_durations(log).select("subject_code", "dx_age", "enroll_age", "mother_age", "debut_to_birth", "onset")


def _severity_cte(updates: str) -> str:
    cut = "('Currently present', 'Used to have')"
    return f"""
s0 AS (SELECT l.*, u.update_id, u.update_date, u.trach_upd AS tu, u.surg_life_upd, u.surg_12m_upd, u.ever_distal, u.below_voice_box AS bv
  FROM patient_log l LEFT JOIN {updates} u ON l.subject_code = u.subject_code),
s1 AS (SELECT *, greatest(update_date, spec_date) AS last_contact, coalesce(tu, trach_log) AS trach_upd, greatest(surg_life_upd, surg_life) AS surgeries,
  CASE WHEN greatest(site_pulmonary, site_bronchus, site_trachea) = 0 THEN 'cleardist' WHEN greatest(site_pulmonary, site_bronchus, site_trachea) <> 0 THEN 'involvdist' END AS dl,
  CASE WHEN ever_distal = 0 THEN 'cleardist' WHEN ever_distal <> 0 THEN 'involvdist' END AS du,
  CASE WHEN bv = 'No' THEN 'cleardist' WHEN bv LIKE '%Yes%' THEN 'involvdist' WHEN bv NOT IN ('Not Recorded', 'Unsure') THEN bv END AS db FROM s0),
s2 AS (SELECT *, CASE WHEN coalesce(trach_upd IN {cut}, false) OR coalesce(trach_log IN {cut}, false) THEN 'trached'
    WHEN coalesce(trach_log = 'Never', false) OR coalesce(trach_upd = 'Never', false) THEN 'Never' END AS tracheostomy,
  CASE WHEN coalesce(dl = 'involvdist', false) OR coalesce(du = 'involvdist', false) OR coalesce(db = 'involvdist', false) THEN 'involvdist'
    WHEN coalesce(dl = 'cleardist', false) OR coalesce(du = 'cleardist', false) OR coalesce(db = 'cleardist', false) THEN 'cleardist' END AS distal,
  {round_sql("date_diff('day', dx_date, last_contact) / 365.25", 2)} AS f0 FROM s1),
s3 AS (SELECT *, CASE WHEN f0 < 0 AND f0 > -0.044 THEN 0 ELSE f0 END AS follow_up FROM s2),
s4 AS (SELECT *, CASE WHEN follow_up < 0.75 THEN NULL ELSE {round_sql('surgeries / nullif(follow_up, 0)', 1)} END AS annual_freq FROM s3),
s5 AS (SELECT *, round_even(greatest(surg_12m, surg_12m_upd, surg_max_12m, annual_freq)::DOUBLE, 0) AS m0 FROM s4),
severity AS (SELECT *, CASE WHEN m0 < 1 THEN 1.0::DOUBLE ELSE m0 END AS max_freq,
  (tracheostomy = 'trached') OR (distal = 'involvdist') OR (surgeries >= 10) OR ((CASE WHEN m0 < 1 THEN 1.0::DOUBLE ELSE m0 END) >= 4) AS aggressive,
  {round_sql("date_diff('day', dob, dx_date) / 365.25", 2)} AS dx_age FROM s5)"""


_ALL_SEVERITY = f"{LOG_CTE}, {UPDATES_CTE}, {_severity_cte('updates')}"
_LATEST_CTE = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_code ORDER BY update_id DESC) AS i FROM updates) WHERE i = 1)"
_SEVERITY_ONCE = f"{UPDATES_CTE}, {_LATEST_CTE}, {_severity_cte('latest')}"


@query(
    f"""WITH {_ALL_SEVERITY} SELECT subject_code, update_id, last_contact, tracheostomy, distal, surgeries, follow_up, annual_freq, max_freq, aggressive FROM severity"""
)
def severity_composite(spark, d):
    affected = cohort.affected_view(patient_log(spark, d), clinical_updates(spark, d))
    return cohort.severity(affected).select(
        "subject_code", "update_id", "last_contact", "tracheostomy", "distal", "surgeries", "follow_up", "annual_freq", "max_freq", "aggressive"
    )


def affected_once(spark, d, people=None):
    """One row per patient, with the latest update, severity and durations; with `people`, the enrolment date
    is that of the person view."""
    latest = clinical_updates(spark, d, latest=True)
    # one row per subject on both sides
    affected = cohort.severity(patient_log(spark, d).join(latest, "subject_code", "left"))
    if people is None:
        return cohort.life_durations(affected.withColumn("enroll_date", F.lit(None).cast("date"))).drop("enroll_date", "enroll_age")
    return cohort.life_durations(cohort.with_enrolment(affected, people))


_REPORT_AGES = ", ".join(f"{a}" for a in report.REPORT_AGES)


def _section(name, source, key, total):
    return f"SELECT '{name}' AS section, {key}::VARCHAR AS item, count(*) AS n, {round_sql(f'count(*)::DOUBLE / (SELECT count(*) FROM {total})', 2)} AS share, NULL::DOUBLE AS value FROM {source} GROUP BY {key}"


def _flag_row(flag):
    return f"SELECT 'flags' AS section, '{flag}' AS item, count(CASE WHEN {flag} THEN 1 END) AS n, {round_sql(f'count(CASE WHEN {flag} THEN 1 END)::DOUBLE / count(*)', 2)} AS share, NULL::DOUBLE AS value FROM a"


def _summary_rows(column):
    parts = {"min": f"min({column})", "q1": f"quantile_cont({column}::DOUBLE, 0.25)", "median": f"quantile_cont({column}::DOUBLE, 0.5)",
        "mean": f"avg({column})", "q3": f"quantile_cont({column}::DOUBLE, 0.75)", "max": f"max({column})"}
    return " UNION ALL ".join(
        f"SELECT 'summary' AS section, '{column} {name}' AS item, count({column}) AS n, NULL::DOUBLE AS share, {round_sql(f'({sql})::DOUBLE', 3)} AS value FROM a"
        for name, sql in parts.items()
    )


@query(
    f"""WITH {_PEOPLE_CTE}, {_SEVERITY_ONCE},
    a AS (SELECT s.*, CASE WHEN dx_age >= 18 THEN 'adult' WHEN dx_age < 18 THEN 'child' END AS onset, {round_sql("date_diff('day', s.dob, q.enroll_date) / 365.25", 2)} AS enroll_age,
      tracheostomy = 'trached' AS trach_flag, distal = 'involvdist' AS distal_flag, surgeries >= 10 AS surgery_flag, max_freq >= 4 AS frequency_flag
      FROM severity s LEFT JOIN people q ON s.subject_code = q.subject_code WHERE NOT regexp_matches(s.subject_code, '^(DAA00003|EAA00004)')),
    p AS (SELECT * FROM people WHERE NOT regexp_matches(subject_code, '^(DAA00003|EAA00004)')),
    f AS (SELECT family, string_agg(relationship, ', ' ORDER BY relationship) AS relationships FROM p GROUP BY 1)
    {' UNION ALL '.join(_section(k, 'a', k, 'a') for k in ('sex', 'race', 'ethnicity', 'onset', 'tracheostomy', 'distal'))}
    UNION ALL {_section('relationship', 'p', 'relationship', 'p')} UNION ALL {_section('families', 'f', 'relationships', 'f')}
    UNION ALL SELECT 'dx_age_at_or_below', x::VARCHAR, NULL, {round_sql('sum((dx_age <= x)::INT)::DOUBLE / count(dx_age)', 2)}, NULL::DOUBLE
      FROM a, (SELECT unnest([{_REPORT_AGES}]) AS x) GROUP BY x
    UNION ALL {' UNION ALL '.join(_flag_row(f) for f in report.FLAGS)} UNION ALL {' UNION ALL '.join(_summary_rows(c) for c in report.MEASURES)}"""
)
def cohort_report(spark, d):
    people = shared(people_of(spark, d), "people")
    affected = shared(report.without_prefixes(affected_once(spark, d, people), EXCLUDED_FAMILIES), "affected")
    return report.cohort_report(affected, report.without_prefixes(people, EXCLUDED_FAMILIES))


# -- integrity ------------------------------------------------------------------------------------


@query(
    f"""WITH {BY_SPECIMEN_CTE}, {UPDATES_CTE}, {_STUDY},
    logged AS (SELECT * FROM patient_log WHERE site_code <> 'HOUSEHOLD')
    SELECT 'missing_in_log' AS check_name, subject_code, recd_date::VARCHAR AS detail FROM (SELECT *, row_number() OVER (PARTITION BY subject_code ORDER BY specimen_id) AS i
      FROM specimens WHERE subject_code LIKE '%PT%' AND subject_code NOT IN (SELECT subject_code FROM logged)) WHERE i = 1
    UNION ALL SELECT 'duplicate_update', subject_code, update_date::VARCHAR FROM updates WHERE subject_code IN (SELECT subject_code FROM updates GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'no_date', subject_code, specimen_id::VARCHAR FROM by_specimen WHERE spec_date IS NULL AND recd_date IS NULL AND collect_date IS NULL
    UNION ALL SELECT 'code_in_foreign_study', subject_code, study_code FROM study WHERE regexp_matches(subject_code, '^[A-Za-z]{{3}}[0-9]{{5}}[A-Za-z]') AND study_code NOT IN ('MAIN', 'MAIN-REL')
    UNION ALL SELECT 'odd_code_in_study', subject_code, study_code FROM study WHERE NOT regexp_matches(subject_code, '^[A-Za-z]{{3}}[0-9]{{5}}[A-Za-z]') AND study_code IN ('MAIN', 'MAIN-REL')
    UNION ALL SELECT 'parent_sex', subject_code, subj_sex FROM specimens WHERE (substr(subject_code, 9, 2) = 'FA' AND subj_sex = 'F') OR (substr(subject_code, 9, 2) = 'MO' AND subj_sex = 'M')
    UNION ALL SELECT 'born_after_collection', subject_code, coalesce(dob, subj_dob)::VARCHAR FROM by_specimen WHERE coalesce(dob, subj_dob) > collect_date
    UNION ALL SELECT 'received_before_collected', subject_code, date_diff('day', collect_date, recd_date)::VARCHAR FROM by_specimen WHERE recd_date < collect_date
    UNION ALL SELECT 'missing_style', subject_code, site_code FROM patient_log WHERE surg_style IS NULL AND site_code <> 'MACHINERY' AND surg_life > 2
    UNION ALL SELECT 'missing_surgeries', subject_code, site_code FROM patient_log WHERE surg_life IS NULL
    UNION ALL SELECT 'more_than_two', subject_code, count(*)::VARCHAR FROM by_specimen GROUP BY subject_code HAVING count(*) > 2
    UNION ALL SELECT 'more_than_one_relative', subject_code, count(*)::VARCHAR FROM by_specimen WHERE relationship <> 'PT' GROUP BY subject_code HAVING count(*) > 1
    UNION ALL SELECT 'duplicate_stock', subject_code, stock_id::VARCHAR FROM specimens WHERE stock_id IN (SELECT stock_id FROM specimens GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'enrolment_gap', subject_code, date_diff('day', min(enroll_date), max(enroll_date))::VARCHAR FROM by_specimen GROUP BY subject_code
      HAVING date_diff('day', min(enroll_date), max(enroll_date)) > 0"""
)
def integrity_report(spark, d):
    log = patient_log(spark, d)
    logged = log.filter(C("site_code") != "HOUSEHOLD")
    # five checks read the specimen view: it is joined once
    view = shared(cohort.specimen_view(log, specimens(spark, d)), "specimen-view")
    dated = view.withColumn("dob", F.coalesce("dob", "subj_dob"))
    return integrity.integrity_report(
        specimens(spark, d), view, dated, logged, log, clinical_updates(spark, d), study_codes(spark, d), ("MAIN", "MAIN-REL"), "MACHINERY"
    )


# -- scores and draws -----------------------------------------------------------------------------

_EXPRESS_CTE = f"""{_SEVERITY_ONCE},
x0 AS (SELECT *, CASE WHEN tracheostomy IS NOT NULL THEN rank() OVER (ORDER BY tracheostomy NULLS LAST) + (count(*) OVER (PARTITION BY tracheostomy) - 1) / 2.0::DOUBLE END AS rt,
  CASE WHEN distal IS NOT NULL THEN rank() OVER (ORDER BY distal NULLS LAST) + (count(*) OVER (PARTITION BY distal) - 1) / 2.0::DOUBLE END AS rd FROM severity),
x1 AS (SELECT *, max_freq * (1 + annual_freq) * (1 + surgeries) * rt * rd / nullif(dx_age, 0) AS e0 FROM x0),
xq AS (SELECT quantile_cont(e0, 0.1) AS q FROM x1),
express AS (SELECT x1.*, coalesce(e0, {signif_sql('q', 2)}) AS express FROM x1, xq)"""


def expressed(spark, d):
    return selection.expression_score(affected_once(spark, d))


@query(f"WITH {LOG_CTE}, {_EXPRESS_CTE} SELECT subject_code, {signif_sql('express', 8)} AS express FROM express")
def expression_score(spark, d):
    return expressed(spark, d).select("subject_code", signif(C("express"), 8).alias("express"))


_QUALITY_CTE = f"""{STOCKS_CTE},
ms AS (SELECT b.specimen_id, b.stock_id, b.subject_code, b.relationship, b.tissue, t.conc, t.volume, t.yield_ug, t.ratio_low FROM by_specimen b JOIN stocks t ON b.specimen_id = t.specimen_id),
wb AS (SELECT *, ln(CASE WHEN yield_ug > 0 THEN yield_ug END) AS lg FROM ms WHERE tissue = 'WB'),
wm AS (SELECT avg(lg) AS a, stddev_samp(lg) AS s FROM wb),
q0 AS (SELECT wb.* EXCLUDE (lg), 1 / ((CASE WHEN -((lg - a) / s) < 1 THEN 1.0::DOUBLE ELSE -((lg - a) / s) END) * (ratio_low + 0.1::DOUBLE)) AS q FROM wb, wm
  UNION ALL SELECT *, CASE WHEN yield_ug <= 0 THEN 0.0001::DOUBLE ELSE yield_ug / (ratio_low + 0.1::DOUBLE) END FROM ms WHERE tissue = 'MW'),
quality AS (SELECT * EXCLUDE (q), q * pow(rank() OVER (ORDER BY tissue) + (count(*) OVER (PARTITION BY tissue) - 1) / 2.0::DOUBLE, 2) AS quality FROM q0)"""


def stocks_once(spark, d):
    """The measures of all stocks as a stage, for queries that need them in several places."""
    return shared(stocks(spark, d), "stocks")


def measured(spark, d, known=None):
    rows = specimens(spark, d).select("specimen_id", "stock_id", "subject_code", "tissue")
    rows = rows.withColumn("relationship", codes.relationship_of(C("subject_code")))
    known = stocks(spark, d) if known is None else known
    return rows.join(known.select("specimen_id", "conc", "volume", "yield_ug", "ratio_low"), "specimen_id")


def qualified(spark, d, known=None):
    return selection.quality_score(measured(spark, d, known))


@query(f"WITH {BY_SPECIMEN_CTE}, {_QUALITY_CTE} SELECT specimen_id, {signif_sql('quality', 8)} AS quality FROM quality")
def quality_score(spark, d):
    return qualified(spark, d).select("specimen_id", signif(C("quality"), 8).alias("quality"))


_SCORE_CTE = f"""{BY_SPECIMEN_CTE}, {_EXPRESS_CTE}, {_QUALITY_CTE},
trios AS (SELECT family, 1 + bool_or(relationship = 'FA')::INT + bool_or(relationship = 'MO')::INT AS trio_number FROM by_specimen GROUP BY 1),
c0 AS (SELECT q.*, e.dx_age, e.max_freq, e.annual_freq, e.surgeries, e.distal, e.tracheostomy, e.type, e.express, t.trio_number,
  CASE WHEN q.stock_id IN (SELECT stock_id FROM specimens WHERE status = 'F') THEN 'haveillumina' ELSE 'noillumina' END AS chip,
  CASE WHEN e.type IN ('6', '11') THEN 4 WHEN e.type IS NOT NULL THEN 2 ELSE 1 END AS rank_type
  FROM quality q JOIN express e ON q.subject_code = e.subject_code JOIN trios t ON substr(q.subject_code, 1, 8) = t.family WHERE q.relationship = 'PT'),
c1 AS (SELECT *, rank() OVER (ORDER BY chip) + (count(*) OVER (PARTITION BY chip) - 1) / 2.0::DOUBLE AS rank_chip FROM c0),
c2 AS (SELECT *, quality * quality * express * trio_number * rank_type / (rank_chip * rank_chip) AS sc FROM c1),
cq AS (SELECT quantile_cont(sc, 0.1) AS q FROM c2),
scored AS (SELECT c2.*, coalesce(sc, {signif_sql('q', 2)}) AS score FROM c2, cq)"""


def scored_stocks(spark, d):
    return score_with(spark, d, shared(qualified(spark, d), "quality"))


def score_with(spark, d, quality):
    on_chip = specimens(spark, d).filter(C("status") == "F").select("stock_id")
    code = C("subject_code")
    members = specimens(spark, d).select(codes.family_of(code).alias("family"), codes.relationship_of(code).alias("relationship"))
    return selection.selection_score(expressed(spark, d), quality, selection.trio_status(members), on_chip)


@query(
    f"WITH {_SCORE_CTE} SELECT specimen_id, stock_id, rank_chip, rank_type, trio_number::INT AS trio_number, {signif_sql('score', 8)} AS score FROM scored"
)
def selection_score(spark, d):
    return scored_stocks(spark, d).select(
        "specimen_id", "stock_id", "rank_chip", "rank_type", "trio_number", signif(C("score"), 8).alias("score")
    )


def _draw_sql(n: int, weight: str, source: str, seed: int, columns: str = "stock_id") -> str:
    key = uniform_sql(seed, "stock_id::VARCHAR || '|' || specimen_id::VARCHAR")
    return f"(SELECT {columns} FROM {source} WHERE {weight} > 0 ORDER BY -ln({key}) / ({weight}), stock_id, specimen_id LIMIT {n})"


_COHORT_CTE = f"""{_SCORE_CTE},
keep AS (SELECT DISTINCT stock_id FROM specimens WHERE tissue <> 'LRNXP' AND subject_code IN ({_listed(MULTIPLEX)})),
fresh AS (SELECT * FROM scored WHERE stock_id NOT IN (SELECT * FROM keep)),
grown AS (SELECT * FROM scored WHERE dx_age > 18),
mild AS (SELECT * FROM fresh WHERE dx_age < 12 AND max_freq < 4 AND surgeries < 10 AND distal = 'cleardist' AND tracheostomy = 'Never' AND annual_freq IS NOT NULL),
main AS {_draw_sql(22, 'score', 'fresh', SEED, '*')},
solid AS (SELECT * FROM main WHERE trio_number = 3 AND tissue = 'WB' AND substr(subject_code, 1, 8) NOT IN ({_listed(EXCLUDED_FAMILIES)})),
parents AS (SELECT stock_id FROM quality WHERE relationship IN ('FA', 'MO') AND tissue = 'WB'
  AND substr(subject_code, 1, 8) IN {_draw_sql(4, 'express', 'solid', SEED + 3, 'substr(subject_code, 1, 8)')}),
drawn AS (SELECT stock_id, 'keep' AS stratum FROM keep UNION SELECT stock_id, 'main' FROM main UNION SELECT stock_id, 'parents' FROM parents
  UNION SELECT stock_id, 'adult' FROM {_draw_sql(8, 'score', 'grown', SEED + 1)} UNION SELECT stock_id, 'mild' FROM {_draw_sql(8, 'score / nullif(express * express, 0)', 'mild', SEED + 2)}),
cohort AS (SELECT stock_id, string_agg(stratum, ',' ORDER BY stratum) AS strata FROM drawn GROUP BY 1)"""


def chosen(spark, d, known=None):
    # the draws read the scores: they are computed once
    quality = shared(qualified(spark, d, known), "quality")
    scored = score_with(spark, d, quality)
    keep = specimens(spark, d).filter((C("tissue") != "LRNXP") & C("subject_code").isin(*MULTIPLEX))
    parents = quality.filter(C("relationship").isin(*codes.PARENTS))
    return selection.select_cohort(scored, keep, SEED, parents=parents, excluded_families=EXCLUDED_FAMILIES, n_parents=4)


@query(f"WITH {_COHORT_CTE} SELECT * FROM cohort")
def select_cohort(spark, d):
    return chosen(spark, d)


@query(
    f"""WITH {_COHORT_CTE}, failed AS (SELECT DISTINCT c.stock_id FROM cohort c JOIN stocks t ON t.specimen_id = c.stock_id WHERE t.conc < 60),
    pool AS (SELECT * FROM scored WHERE stock_id NOT IN (SELECT stock_id FROM cohort)),
    ranked AS (SELECT stock_id, specimen_id, row_number() OVER (ORDER BY -ln({uniform_sql(SEED + 9, "stock_id::VARCHAR || '|' || specimen_id::VARCHAR")}) / score, stock_id, specimen_id) AS i FROM pool WHERE score > 0)
    SELECT stock_id, specimen_id FROM ranked WHERE i <= (SELECT count(*) FROM failed)"""
)
def replacement_draw(spark, d):
    """A fresh stock for each drawn one that holds too little, none of them drawn before."""
    scored = scored_stocks(spark, d)
    cohort_rows = shared(chosen(spark, d), "chosen")
    weak = stocks(spark, d).filter(C("conc") < 60).select(C("specimen_id").alias("stock_id"))
    failed = cohort_rows.join(weak, "stock_id", "left_semi")
    return selection.replacements(scored, cohort_rows, failed, SEED + 9).select("stock_id", "specimen_id")


_KEY = uniform_sql(SEED, "family")


@query(
    f"""WITH {SPECIMENS_CTE}, m AS (SELECT *, substr(subject_code, 1, 8) AS family FROM specimens),
    h AS (SELECT family, sum(CASE tissue WHEN 'WB' THEN 10 WHEN 'MW' THEN 4 WHEN 'BUC' THEN 3 WHEN 'LRNXP' THEN 5 ELSE 0 END) AS score, count(DISTINCT subject_code) AS members,
      max((substr(subject_code, 9, 2) = 'FA')::INT) + max((substr(subject_code, 9, 2) = 'MO')::INT) AS parents FROM m GROUP BY 1),
    v AS (SELECT family, pow(parents, 3) * score * score / members AS value FROM h),
    f AS (SELECT family FROM v WHERE value > 0 ORDER BY -ln({_KEY}) / value, family LIMIT 98)
    SELECT specimen_id, subject_code, family, tissue FROM m WHERE ((family IN (SELECT * FROM f) AND tissue IN ('MW', 'WB'))
      OR (tissue <> 'LRNXP' AND subject_code IN ({_listed(MULTIPLEX)}))) AND specimen_id NOT IN (SELECT specimen_id FROM specimens WHERE status = 'F')"""
)
def select_families(spark, d):
    done = specimens(spark, d).filter(C("status") == "F")
    return selection.select_families(specimens(spark, d), 98, SEED, MULTIPLEX, done)


_TRIOS_CTE = f"""{_SCORE_CTE},
r0 AS (SELECT subject_code, relationship, stock_id, specimen_id, conc, quality, score / nullif(express, 0) AS assay, trio_number FROM scored
  UNION ALL SELECT subject_code, relationship, stock_id, specimen_id, conc, quality, NULL, NULL FROM quality WHERE relationship <> 'PT'),
r1 AS (SELECT *, substr(subject_code, 1, 8) AS family FROM r0),
r2 AS (SELECT * FROM r1 WHERE family NOT IN ({_listed(EXCLUDED_FAMILIES)}) AND relationship NOT IN ('SI', 'MGM', 'MGF')
  AND stock_id NOT IN (SELECT stock_id FROM specimens WHERE status = 'O')),
r3 AS (SELECT * FROM r2 WHERE family IN (SELECT family FROM r2 WHERE trio_number = 3) AND conc >= 30),
fs AS (SELECT family, CASE WHEN count(quality) = count(*) THEN sum(ln(quality)) + ln(max(assay)) END AS log_score FROM r3 GROUP BY 1),
fd AS (SELECT family, log_score FROM fs WHERE log_score IS NOT NULL ORDER BY ln(-ln({_KEY})) - log_score, family LIMIT 67)"""


def trio_stocks(spark, d, known=None):
    quality = shared(qualified(spark, d, known), "quality")
    scored = score_with(spark, d, quality)
    excluded = specimens(spark, d).select(codes.family_of(C("subject_code")).alias("family")).filter(C("family").isin(*EXCLUDED_FAMILIES)).distinct()
    done = specimens(spark, d).filter(C("status") == "O")
    return selection.select_trios(scored, quality, excluded, done, 67, SEED)


@query(
    f"""WITH {_TRIOS_CTE} SELECT r3.family, subject_code, relationship, stock_id, specimen_id, conc, {round_sql('log_score', 6)} AS log_score
    FROM r3 JOIN fd ON r3.family = fd.family"""
)
def select_trios(spark, d):
    return trio_stocks(spark, d).withColumn("log_score", round_even(C("log_score"), 6))


# -- plates ---------------------------------------------------------------------------------------


@query(
    f"""WITH {STOCKS_CTE}, a AS (SELECT specimen_id, conc, CASE WHEN conc < 50 THEN {signif_sql('(1000 / conc)', 2)} ELSE {signif_sql('(750 / conc)', 2)} END AS p0 FROM stocks),
    b AS (SELECT *, CASE WHEN p0 < 5 THEN 5.0::DOUBLE ELSE p0 END AS pip_stock FROM a),
    c AS (SELECT *, CASE WHEN conc < 50 THEN 0.0::DOUBLE ELSE {signif_sql('(pip_stock * conc / 75 - pip_stock)', 2)} END AS d0 FROM b)
    SELECT specimen_id, pip_stock, CASE WHEN pip_stock + d0 < 20 THEN {signif_sql('(pip_stock * conc / 50 - pip_stock)', 2)} ELSE d0 END AS pip_diluent FROM c"""
)
def pipette_plan(spark, d):
    return plates.pipette_plan(stocks(spark, d).select("specimen_id", "conc")).drop("conc")


_PLATES_CTE = f"""{STOCKS_CTE},
g0 AS (SELECT s.specimen_id, s.stock_id, s.tissue, t.conc, row_number() OVER (ORDER BY t.conc NULLS LAST, s.stock_id, s.specimen_id) - 1 AS z
  FROM specimens s LEFT JOIN stocks t ON s.specimen_id = t.specimen_id WHERE s.tissue <> 'LRNXP'),
g1 AS (SELECT *, z // 95 + 1 AS plate, z % 95 + 1 AS slot, (1 + floor({uniform_sql(SEED, '(z // 95 + 1)')} * 96))::INT AS hole FROM g0),
g2 AS (SELECT plate, (slot + CASE WHEN slot >= hole THEN 1 ELSE 0 END)::INT AS position, stock_id, specimen_id, round_even(conc, 0) AS conc, tissue FROM g1
  UNION ALL SELECT DISTINCT plate, hole, 0, NULL, NULL, NULL FROM g1),
plating AS (SELECT plate, chr((65 + (position - 1) % 8)::INT) || ((position - 1) // 8 + 1)::VARCHAR AS well, position, stock_id, specimen_id, conc, tissue FROM g2),
pstats AS (SELECT plate, min(conc) AS min_conc, median(conc) AS median_conc, max(conc) AS max_conc FROM plating GROUP BY 1),
pvol AS (SELECT *, CASE WHEN median_conc <= 20 THEN 6 WHEN median_conc > 20 THEN 5 END AS dna_to_add FROM pstats),
volumes AS (SELECT *, CASE WHEN round_even(median_conc * dna_to_add / 20 - dna_to_add, 0) < 0 THEN 0.0::DOUBLE ELSE round_even(median_conc * dna_to_add / 20 - dna_to_add, 0) END AS water_to_add FROM pvol)"""


def germline_plates(spark, d, sent=None, known=None):
    rows = specimens(spark, d).filter(C("tissue") != "LRNXP").select("specimen_id", "stock_id", "tissue")
    if sent is not None:
        rows = salted_join(rows, sent, ["stock_id"], "left_anti", hot=[])
    known = stocks(spark, d) if known is None else known
    with_conc = rows.join(known.select("specimen_id", "conc"), "specimen_id", "left")
    return plates.plate_layout(with_conc, SEED)


@query(f"WITH {SPECIMENS_CTE}, {_PLATES_CTE} SELECT * FROM plating")
def plate_layout(spark, d):
    return germline_plates(spark, d)


@query(f"WITH {SPECIMENS_CTE}, {_PLATES_CTE} SELECT plate, min_conc, median_conc, max_conc, dna_to_add, water_to_add FROM volumes")
def plate_stats(spark, d):
    return plates.dilution_volumes(plates.plate_stats(germline_plates(spark, d)))


@query(
    f"""WITH {SPECIMENS_CTE}, {_PLATES_CTE} SELECT p.plate, well, stock_id, conc * dna_to_add AS total_ng, dna_to_add + water_to_add AS total_ul,
    {round_sql('conc * dna_to_add / (dna_to_add + water_to_add)', 6)} AS diluted_conc FROM plating p JOIN volumes v ON p.plate = v.plate"""
)
def dilution_plan(spark, d):
    layout = shared(germline_plates(spark, d), "plates")
    planned = plates.dilution_plan(layout, plates.dilution_volumes(plates.plate_stats(layout)))
    return planned.select("plate", "well", "stock_id", "total_ng", "total_ul", round_even(C("diluted_conc"), 6).alias("diluted_conc"))


@query(f"WITH {_COHORT_CTE}, {_PLATES_CTE.replace(STOCKS_CTE + ',', '')} SELECT c.stock_id, p.plate, p.well FROM cohort c LEFT JOIN plating p ON c.stock_id = p.stock_id")
def locate_samples(spark, d):
    known = stocks_once(spark, d)
    return selection.locate_samples(shared(chosen(spark, d, known), "chosen"), germline_plates(spark, d, known=known))


_SENT = uniform_sql(106, "specimen_id")


@query(
    f"""WITH {SPECIMENS_CTE}, sent AS (SELECT stock_id FROM specimens WHERE tissue <> 'LRNXP' ORDER BY {_SENT}, specimen_id LIMIT 106),
    {_PLATES_CTE.replace("WHERE s.tissue <> 'LRNXP'", "WHERE s.tissue <> 'LRNXP' AND s.stock_id NOT IN (SELECT stock_id FROM sent)")} SELECT * FROM plating"""
)
def plate_layout_minus_sent(spark, d):
    """The layout without the stocks of an earlier random sample."""
    germline = specimens(spark, d).filter(C("tissue") != "LRNXP").select("specimen_id", "stock_id")
    return germline_plates(spark, d, sample_n(germline, 106, ["specimen_id"], 106).select("stock_id"))


@query(
    f"""WITH {_TRIOS_CTE}, {_PLATES_CTE.replace(STOCKS_CTE + ',', '')}, {_PEOPLE_CTE.replace(BY_SPECIMEN_CTE + ',', '')},
    w AS (SELECT r3.subject_code, sex, ethnicity, race, r3.stock_id, r3.specimen_id, t.conc, t.volume, t.abs_ratio, t.yield_ug, r3.family, r3.relationship
      FROM r3 JOIN fd ON r3.family = fd.family LEFT JOIN people p ON r3.subject_code = p.subject_code JOIN stocks t ON r3.specimen_id = t.specimen_id),
    a AS (SELECT *, CASE WHEN conc < 50 THEN {signif_sql('(1000 / conc)', 2)} ELSE {signif_sql('(750 / conc)', 2)} END AS p0 FROM w),
    b AS (SELECT *, CASE WHEN p0 < 5 THEN 5.0::DOUBLE ELSE p0 END AS pip_stock FROM a),
    c AS (SELECT *, CASE WHEN conc < 50 THEN 0.0::DOUBLE ELSE {signif_sql('(pip_stock * conc / 75 - pip_stock)', 2)} END AS d0 FROM b)
    SELECT c.subject_code, sex, ethnicity, race, c.stock_id, c.specimen_id, c.conc, volume, {round_sql('abs_ratio', 6)} AS abs_ratio, {round_sql('yield_ug', 6)} AS yield_ug, family, relationship, plate, well, pip_stock,
    CASE WHEN pip_stock + d0 < 20 THEN {signif_sql('(pip_stock * c.conc / 50 - pip_stock)', 2)} ELSE d0 END AS pip_diluent
    FROM c LEFT JOIN (SELECT DISTINCT stock_id, plate, well FROM plating) l ON c.stock_id = l.stock_id"""
)
def trio_worklist(spark, d):
    """Trio selection end to end: draw, demographics, position, volumes."""
    known = stocks_once(spark, d)
    worklist = selection.trio_worklist(trio_stocks(spark, d, known), people_of(spark, d), known, germline_plates(spark, d, known=known))
    return _rounded(worklist, 6, "abs_ratio", "yield_ug")


_CALLS = tuple(f"snp_{i:02d}" for i in range(1, 12))
_CALLS_SQL = ", ".join(f"CASE WHEN c % {i + 2} <> 0 THEN 'G' END AS {name}" for i, name in enumerate(_CALLS))
_MISSED_SQL = " + ".join(f"({name} IS NULL)::INT" for name in _CALLS)
_QC_CTE = f"""{SPECIMENS_CTE}, {STOCKS_CTE},
rep AS (SELECT o_orderkey AS position, o_totalprice / 10 AS copies, o_orderstatus <> 'F' AS passed, {_CALLS_SQL} FROM (SELECT *, {cents_sql('o_totalprice')} AS c FROM orders)),
sent AS (SELECT t.specimen_id AS position, s.tissue, t.conc FROM stocks t JOIN specimens s ON s.specimen_id = t.specimen_id),
qc AS (SELECT *, copies / 320 / 2 AS qc_conc, {_MISSED_SQL} AS missing_calls FROM rep JOIN sent USING (position))"""


def compared(spark, d):
    c = cents(C("o_totalprice"))
    orders = table(spark, d, "orders").select(
        C("o_orderkey").alias("position"),
        (C("o_totalprice") / 10).alias("copies"),
        (C("o_orderstatus") != "F").alias("passed"),
        *[F.when(F.pmod(c, F.lit(i + 2)) != 0, "G").alias(name) for i, name in enumerate(_CALLS)],
    )
    sent = specimens(spark, d).select("specimen_id", "tissue").join(stocks(spark, d).select("specimen_id", "conc"), "specimen_id")
    return plates.qc_join(orders, sent.withColumnRenamed("specimen_id", "position"), _CALLS)


@query(
    f"""WITH {_QC_CTE} SELECT position, missing_calls, {round_sql('qc_conc', 6)} AS qc_conc,
    (rank() OVER (ORDER BY conc) + (count(*) OVER (PARTITION BY conc) - 1) / 2.0::DOUBLE) - (rank() OVER (ORDER BY copies) + (count(*) OVER (PARTITION BY copies) - 1) / 2.0::DOUBLE) AS rank_diff FROM qc"""
)
def qc_compare(spark, d):
    return compared(spark, d).select("position", "missing_calls", round_even(C("qc_conc"), 6).alias("qc_conc"), "rank_diff")


@query(
    f"""WITH {_QC_CTE} SELECT passed, tissue, count(*) AS n, {round_sql('min(conc)', 4)} AS min_sent, {round_sql('min(qc_conc)', 4)} AS min_qc, {round_sql('max(qc_conc)', 4)} AS max_qc,
    {round_sql('quantile_cont(conc, 0.1)', 4)} AS p10_sent, {round_sql('quantile_cont(qc_conc, 0.1)', 4)} AS p10_qc, {round_sql('quantile_cont(qc_conc, 0.5)', 4)} AS p50_qc FROM qc GROUP BY 1, 2"""
)
def qc_summary(spark, d):
    out = plates.qc_summary(compared(spark, d))
    return _rounded(out, 4, "min_sent", "min_qc", "max_qc", "p10_sent", "p10_qc", "p50_qc")


# -- markers --------------------------------------------------------------------------------------


@query(
    """WITH chip AS (SELECT DISTINCT l_partkey AS name FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.07),
    m AS (SELECT p_partkey AS marker, p_partkey + 1 AS a, p_partkey + p_size AS b, CASE WHEN p_size % 2 = 0 THEN p_partkey + 100 END AS c FROM part),
    px AS (SELECT marker, a AS proxy FROM m UNION SELECT marker, b FROM m UNION SELECT marker, c FROM m WHERE c IS NOT NULL),
    h AS (SELECT marker, string_agg(proxy::VARCHAR, ',' ORDER BY proxy::VARCHAR) AS by_proxy FROM px WHERE proxy IN (SELECT name FROM chip) GROUP BY 1)
    SELECT m.marker, CASE WHEN m.marker IN (SELECT name FROM chip) THEN 'direct' WHEN by_proxy IS NOT NULL THEN 'proxy' ELSE 'absent' END AS coverage,
    CASE WHEN m.marker NOT IN (SELECT name FROM chip) THEN by_proxy END AS by_proxy FROM m LEFT JOIN h ON m.marker = h.marker"""
)
def marker_coverage(spark, d):
    from kinsieve.operators.reshape import unpivot_long

    chip = table(spark, d, "lineitem").filter((C("l_quantity") > 49) & (C("l_discount") > 0.07)).select(C("l_partkey").alias("name"))
    wide = table(spark, d, "part").select(
        C("p_partkey").alias("marker"),
        (C("p_partkey") + 1).alias("proxy_01"),
        (C("p_partkey") + C("p_size")).alias("proxy_02"),
        F.when(C("p_size") % 2 == 0, C("p_partkey") + 100).alias("proxy_03"),
    )
    proxies = unpivot_long(wide, ["marker"], ["proxy_01", "proxy_02", "proxy_03"], "slot", "proxy").drop("slot")
    return selection.marker_coverage(wide.select("marker"), proxies.filter(C("proxy").isNotNull()), chip)
