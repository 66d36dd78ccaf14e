"""Joins, set operations, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsieve.catalog import query
from kinsieve.catalog.standins import (
    LOG_CTE,
    SPECIMENS_CTE,
    STOCKS_CTE,
    code_sql,
    patient_log,
    specimens,
    stocks,
    subject_code,
    table,
)
from kinsieve.functions import codes
from kinsieve.operators import reshape, summaries
from kinsieve.operators.joins import (
    constant_update,
    first_per_key,
    inherit_from_relative,
    lookup_update,
    salted_join,
)
from kinsieve.operators.ordered import asc
from kinsieve.plans.report import contact_list as contacts, site_contacts

C = F.col


# -- joins ----------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def join_inner(spark, d):
    subjects = table(spark, d, "customer").select(C("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return salted_join(orders, subjects, ["o_custkey"], "inner").drop("o_custkey")


@query(f"WITH {SPECIMENS_CTE}, {LOG_CTE} SELECT specimen_id, s.subject_code, sex, race FROM specimens s LEFT JOIN patient_log l ON s.subject_code = l.subject_code")
def join_left(spark, d):
    log = patient_log(spark, d).select("subject_code", "sex", "race")
    return salted_join(specimens(spark, d).select("specimen_id", "subject_code"), log, ["subject_code"], "left")


@query(f"WITH {STOCKS_CTE} SELECT o_orderkey AS specimen_id, conc, volume FROM stocks RIGHT JOIN orders ON specimen_id = o_orderkey")
def join_right(spark, d):
    """All specimens with their stock: the right join, written with the kept side first."""
    wanted = table(spark, d, "orders").select(C("o_orderkey").alias("specimen_id"))
    return stocks(spark, d).select("specimen_id", "conc", "volume").join(wanted, "specimen_id", "right")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, d):
    measured = table(spark, d, "lineitem").select(C("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").transform(
        salted_join, measured, ["o_orderkey"], "left_anti", hot=[]
    )


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_semi(spark, d):
    rich = table(spark, d, "lineitem").filter(C("l_quantity") > 45).select(C("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").transform(
        salted_join, rich, ["o_orderkey"], "left_semi", hot=[]
    )


@query(
    f"""WITH {LOG_CTE}, u AS (SELECT {code_sql('(user_id * 4)')} AS subject_code,
      arg_max(event_type, event_id) AS k, max(event_id) AS e FROM events GROUP BY 1)
    SELECT l.subject_code, CASE WHEN u.subject_code IS NOT NULL THEN CASE WHEN k <> 'error' THEN k END ELSE l.type END AS type,
    CASE WHEN l.site_code IN ('MACHINERY', 'FURNITURE') THEN 'closed' END AS site_state
    FROM patient_log l LEFT JOIN u ON l.subject_code = u.subject_code""",
    name="lookup_update",
)
def lookup_update_query(spark, d):
    """Patients with an event take the type of their last one (a missing one included); the others keep
    theirs. Then a constant for listed sites."""
    events = table(spark, d, "events").select(
        subject_code(C("user_id") * 4).alias("subject_code"),
        F.when(C("event_type") != "error", C("event_type")).alias("new_type"),
        "event_id",
    )
    updated = lookup_update(
        patient_log(spark, d).select("subject_code", "type", "site_code"),
        events, ["subject_code"], {"type": "new_type"}, [asc("event_id")], hot=[],
    )
    closed = constant_update(updated, "site_code", ["MACHINERY", "FURNITURE"], "site_state", "closed")
    return closed.drop("site_code")


@query(
    f"""WITH s AS (SELECT {code_sql('c_custkey')} AS code, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer),
    p AS (SELECT substr(code, 1, 8) AS family, segment FROM s WHERE substr(code, 9) = 'PT')
    SELECT code AS subject_code, CASE WHEN substr(code, 9) LIKE 'S%' AND s.segment IS NULL THEN p.segment ELSE s.segment END AS segment
    FROM s LEFT JOIN p ON substr(s.code, 1, 8) = p.family"""
)
def family_inherit(spark, d):
    people = table(spark, d, "customer").select(
        subject_code(C("c_custkey")).alias("subject_code"),
        F.when(C("c_mktsegment") != "BUILDING", C("c_mktsegment")).alias("segment"),
    ).withColumn("family", codes.family_of(C("subject_code")))
    suffix = codes.suffix_of(C("subject_code"))
    return inherit_from_relative(
        people, "family", ["segment"], suffix == codes.PATIENT, suffix.startswith("S"), [asc("subject_code")]
    ).drop("family")


@query(
    f"""WITH {SPECIMENS_CTE} SELECT specimen_id, subject_code, tissue FROM specimens WHERE subject_code IN
    (SELECT subject_code FROM specimens WHERE tissue = 'WB' GROUP BY 1 HAVING count(*) > 6)"""
)
def detail_of_violations(spark, d):
    rows = specimens(spark, d).select("specimen_id", "subject_code", "tissue")
    many = summaries.counts_by(rows.filter(C("tissue") == "WB"), "subject_code").filter(C("n") > 6)
    return summaries.rows_of(rows, many.select("subject_code"), ["subject_code"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
def in_set(spark, d):
    return table(spark, d, "customer").filter(C("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def not_in_set(spark, d):
    owing = table(spark, d, "supplier").filter(C("s_acctbal") < 0).select(C("s_suppkey").alias("l_suppkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return salted_join(lines, owing, ["l_suppkey"], "left_anti")


@query(
    f"""WITH {SPECIMENS_CTE} SELECT subject_code, recd_date, tissue FROM (SELECT *, row_number() OVER (PARTITION BY subject_code ORDER BY specimen_id) AS i
    FROM specimens WHERE tissue = 'LRNXP') WHERE i = 1"""
)
def key_lookup_first(spark, d):
    wanted = specimens(spark, d).filter(C("tissue") == "LRNXP").select("subject_code", "recd_date", "tissue", "specimen_id")
    return first_per_key(wanted, ["subject_code"], [asc("specimen_id")]).drop("specimen_id")


# -- set operations -------------------------------------------------------------------------------


@query(
    """SELECT s_nationkey AS nationkey, s_acctbal AS amount, 'supplier' AS source FROM supplier
    UNION ALL SELECT c_nationkey, c_acctbal, 'customer' FROM customer"""
)
def union_tagged(spark, d):
    return reshape.union_tagged(
        {
            "supplier": table(spark, d, "supplier").select(C("s_nationkey").alias("nationkey"), C("s_acctbal").alias("amount")),
            "customer": table(spark, d, "customer").select(C("c_nationkey").alias("nationkey"), C("c_acctbal").alias("amount")),
        }
    )


@query(
    """SELECT s_suppkey AS key, s_name AS name, s_acctbal AS amount, NULL::VARCHAR AS segment FROM supplier
    UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer"""
)
def union_fill(spark, d):
    late = table(spark, d, "supplier").select(C("s_suppkey").alias("key"), C("s_name").alias("name"), C("s_acctbal").alias("amount"))
    early = table(spark, d, "customer").select(C("c_custkey").alias("key"), C("c_mktsegment").alias("segment"), C("c_name").alias("name"))
    return reshape.union_fill(late, early)


@query("SELECT s_nationkey AS nationkey FROM supplier UNION SELECT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation")
def union_distinct(spark, d):
    return reshape.union_distinct(
        table(spark, d, "supplier").select(C("s_nationkey").alias("nationkey")),
        table(spark, d, "customer").select(C("c_nationkey").alias("nationkey")),
        table(spark, d, "nation").select(C("n_nationkey").alias("nationkey")),
    )


@query("SELECT l_partkey AS marker FROM lineitem WHERE l_discount > 0.08 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20")
def set_intersect(spark, d):
    asked = table(spark, d, "lineitem").filter(C("l_discount") > 0.08).select(C("l_partkey").alias("marker"))
    return asked.intersect(table(spark, d, "part").filter(C("p_size") < 20).select(C("p_partkey").alias("marker")))


@query("SELECT p_partkey AS marker FROM part EXCEPT SELECT CASE WHEN l_quantity < 40 THEN l_partkey END FROM lineitem WHERE l_discount > 0.08")
def set_difference(spark, d):
    used = table(spark, d, "lineitem").filter(C("l_discount") > 0.08).select(F.when(C("l_quantity") < 40, C("l_partkey")).alias("marker"))
    return table(spark, d, "part").select(C("p_partkey").alias("marker")).subtract(used)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    """SELECT DISTINCT p_brand AS list_name, p_partkey AS marker FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)"""
)
def list_coverage(spark, d):
    wanted = table(spark, d, "part").select(C("p_brand").alias("list_name"), C("p_partkey").alias("marker"))
    made = table(spark, d, "lineitem").filter(C("l_quantity") > 48).select(C("l_partkey").alias("marker"))
    return reshape.missing_items(wanted, made, "list_name", "marker")


# -- reshape --------------------------------------------------------------------------------------


@query(
    """SELECT c_mktsegment AS segment, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o,
    nullif(count(CASE WHEN o_orderstatus = 'X' THEN 1 END), 0) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
)
def pivot_wide(spark, d):
    segments = table(spark, d, "customer").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("segment"))
    long = salted_join(table(spark, d, "orders").select("o_custkey", "o_orderstatus"), segments, ["o_custkey"], "inner")
    counted = summaries.counts_by(long, "segment", "o_orderstatus")
    wide = reshape.pivot_wide(counted, ["segment"], "o_orderstatus", ["F", "O", "X"], F.first("n"))
    return wide.toDF("segment", "f", "o", "x")


@query(
    """SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem"""
)
def unpivot_long(spark, d):
    return reshape.unpivot_long(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query(
    """SELECT doc_id, 1 AS position, 'quality' AS kind, quality AS score FROM labels UNION ALL SELECT doc_id, 2, 'toxic', toxic FROM labels"""
)
def unpivot_pairs(spark, d):
    wide = table(spark, d, "labels").select(
        "doc_id", F.lit("quality").alias("kind_1"), C("quality").alias("score_1"), F.lit("toxic").alias("kind_2"), C("toxic").alias("score_2")
    )
    return reshape.unpivot_groups(wide, ["doc_id"], {"kind": ["kind_1", "kind_2"], "score": ["score_1", "score_2"]})


@query(
    """WITH w AS (SELECT s_suppkey, s_name, lower(replace(s_name, '#', '')) || '@a.example' AS m1,
      CASE WHEN s_acctbal > 0 THEN lower(n_name) || '@b.example' END AS m2,
      CASE WHEN s_suppkey % 3 = 0 THEN 'Old work' ELSE 'work' END AS k1, 'home' AS k2 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    l AS (SELECT s_name, k1 AS k, m1 AS m FROM w UNION ALL SELECT s_name, k2, m2 FROM w),
    p AS (SELECT s_name, string_agg(m, ',' ORDER BY m) AS mails FROM l WHERE m IS NOT NULL AND NOT regexp_matches(k, '(?i)old') GROUP BY 1),
    sites AS (SELECT c_custkey AS site_key, c_name AS hospital, 'Supplier#' || lpad((c_custkey % 150 + 1)::VARCHAR, 9, '0') AS s_name,
      CASE WHEN c_acctbal > 0 THEN c_nationkey END AS approval FROM customer)
    SELECT site_key, hospital, s.s_name AS person, mails FROM sites s LEFT JOIN p ON s.s_name = p.s_name WHERE approval IS NOT NULL"""
)
def contact_list(spark, d):
    """Addresses per person, attached by name to the approved sites."""
    nation = table(spark, d, "nation").select(C("n_nationkey").alias("s_nationkey"), "n_name")
    people = salted_join(table(spark, d, "supplier"), nation, ["s_nationkey"], "inner").select(
        C("s_name").alias("person"),
        F.when(F.pmod("s_suppkey", F.lit(3)) == 0, "Old work").otherwise("work").alias("kind_1"),
        F.concat(F.lower(F.replace(C("s_name"), F.lit("#"), F.lit(""))), F.lit("@a.example")).alias("mail_1"),
        F.lit("home").alias("kind_2"),
        F.when(C("s_acctbal") > 0, F.concat(F.lower("n_name"), F.lit("@b.example"))).alias("mail_2"),
    )
    number = F.lpad((F.pmod("c_custkey", F.lit(150)) + 1).cast("string"), 9, "0")
    sites = table(spark, d, "customer").select(
        C("c_custkey").alias("site_key"),
        C("c_name").alias("hospital"),
        F.concat(F.lit("Supplier#"), number).alias("person"),
        F.when(C("c_acctbal") > 0, C("c_nationkey")).alias("approval"),
    )
    mails = contacts(people, ["person"], ["kind_1", "kind_2"], ["mail_1", "mail_2"])
    return site_contacts(sites, mails, ["person"]).select("site_key", "hospital", "person", "mails")


@query("SELECT regexp_matches(p_name, '(?i)RED|small') AS flagged, count(*) AS n FROM part GROUP BY 1")
def like_flag_counts(spark, d):
    return summaries.counts_by(table(spark, d, "part"), C("p_name").rlike("(?i)RED|small").alias("flagged"))
