"""Registered queries against their SQL, and independence of the cluster layout.

A representative part runs by default; KINSIEVE_ALL=1 runs every query.
"""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_points
from check_oracle import TABLES, compare, compare_types
from kinsieve import catalog
from kinsieve.operators import ordered

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "family_composition", "clean_rules", "factor_encode", "lookup_update", "family_inherit", "avg_rank", "group_stats",
    "ecdf_steps", "histogram_bins", "string_agg", "drop_nth_duplicate", "person_view", "severity_composite",
    "integrity_report", "plate_layout", "dilution_plan", "select_trios", "locate_samples", "scan_csv", "scan_projected",
    "scan_whitespace", "ols_interaction", "ols_category", "group_means_ci", "duration_years", "contact_list", "weighted_sample_n",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for name in TABLES.split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


def names():
    catalog.load_all()
    return list(catalog.QUERIES) if os.environ.get("KINSIEVE_ALL") else list(QUICK)


@pytest.mark.parametrize("name", names())
def test_query_agrees_with_sql(spark, sql, name):
    df = entry_points.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    oracle = entry_points.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    result = sql.execute(oracle)
    columns = [d[0] for d in result.description]
    assert compare(df.columns, rows, columns, result.fetchall()) is None
    assert compare_types(df, result.description) is None


def test_every_query_is_registered_with_its_sql():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set()


@pytest.mark.parametrize("name", ["avg_rank", "locf_family", "plate_layout", "ecdf_steps", "every_kth", "duplicated_rows"])
def test_same_answer_with_other_partitions_and_buckets(spark, name, monkeypatch):
    query = entry_points.queries()[name]
    plain = Counter(map(tuple, query(spark, FOLDER).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 101)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert Counter(map(tuple, query(spark, FOLDER).collect())) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["stock_id", "plate", "well"] and df.count() > 0
