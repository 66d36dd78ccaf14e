"""Sources and sinks. Text inputs are written from the given tables first, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinsieve.catalog import query
from kinsieve.catalog.standins import table
from kinsieve.functions.codes import first_match
from kinsieve.session import scratch_path
from kinsieve.sources import tables as readers
from kinsieve.sources import writers

C = F.col


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment FROM customer")
def scan_csv(spark, d):
    path = scratch_path(spark, "csv")
    segment = F.when(C("c_mktsegment") != "MACHINERY", C("c_mktsegment")).alias("segment")
    writers.write_delimited(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", segment), path)
    fields = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, segment string"
    return readers.read_delimited(spark, path, fields)


@query("SELECT p_partkey AS marker_key, p_type AS chip FROM part")
def scan_projected(spark, d):
    """Two of five fields of a manifest whose trailing control section must not be read as data."""
    path = scratch_path(spark, "manifest")
    shards = spark.sparkContext.defaultParallelism
    shard = F.pmod(F.xxhash64("p_partkey"), F.lit(shards))
    part = table(spark, d, "part").withColumn("shard", shard)
    text = F.concat_ws(",", C("p_partkey"), "p_name", "p_brand", "p_type", C("p_size"))
    body = part.select("shard", F.lit(0).alias("block"), "p_partkey", text.alias("value"))
    marker = part.select("shard").distinct().select(
        "shard", F.lit(1).alias("block"), F.lit(0).alias("p_partkey"), F.lit("[Controls]").alias("value")
    )
    control = part.select("shard", F.lit(2).alias("block"), "p_partkey", F.concat_ws(",", C("p_partkey"), F.lit("control")).alias("value"))
    # every file ends in its own control section
    sections = body.unionByName(marker).unionByName(control).repartition(shards, "shard")
    sections.sortWithinPartitions("block", "p_partkey").select("value").write.text(path)
    return readers.read_before_trailer(
        spark, path, {"marker_key": (0, "bigint"), "chip": (3, "string")}, C("value") == "[Controls]"
    )


@query("SELECT s_suppkey AS snp_id, s_nationkey AS chr, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS score FROM supplier")
def scan_whitespace(spark, d):
    path = scratch_path(spark, "whitespace")
    supplier = table(spark, d, "supplier")
    score = F.when(C("s_acctbal") >= 0, C("s_acctbal").cast("string")).otherwise("NA")
    line = F.concat(F.lit("  "), C("s_suppkey").cast("string"), F.lit("\t"), C("s_nationkey").cast("string"), F.lit("   "), score)
    writers.write_lines(supplier.select(line.alias("value")), path, header="snp_id chr score")
    return readers.read_whitespace(spark, path, {"snp_id": "bigint", "chr": "int", "score": "double"})


@query(
    """SELECT o_orderkey AS specimen_id, o_custkey AS subject_key, o_orderpriority AS tissue FROM orders
    WHERE o_orderstatus = 'P' AND o_orderkey <> 1001 AND o_orderkey <> 1002"""
)
def scan_filtered(spark, d):
    orders = table(spark, d, "orders")
    return orders.filter((C("o_orderstatus") == "P") & (C("o_orderkey") != 1001) & (C("o_orderkey") != 1002)).select(
        C("o_orderkey").alias("specimen_id"), C("o_custkey").alias("subject_key"), C("o_orderpriority").alias("tissue")
    )


@query("SELECT n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def scan_parquet(spark, d):
    """Several tables saved as one snapshot, loaded by name."""
    folder = scratch_path(spark, "snapshot")
    names = ("supplier", "nation", "region")
    writers.write_snapshot({n: table(spark, d, n) for n in names}, folder)
    t = readers.read_snapshot(spark, folder)
    joined = t["supplier"].join(t["nation"], C("s_nationkey") == C("n_nationkey")).join(t["region"], C("n_regionkey") == C("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey, v.description AS consent FROM orders LEFT JOIN (VALUES (0, 'this project only'), (1, 'any project'),
    (2, 'any project, no genetics'), (3, 'ask first')) v(code, description) ON o_orderkey % 5 = v.code"""
)
def lookup_literal(spark, d):
    consent = readers.literal_table(
        spark,
        [(0, "this project only"), (1, "any project"), (2, "any project, no genetics"), (3, "ask first")],
        "code long, consent string",
    )
    coded = table(spark, d, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(5)).alias("code"))
    # four rows written in code
    return coded.join(F.broadcast(consent), "code", "left").select("o_orderkey", "consent")


@query("SELECT regexp_extract(p_name, '[a-z]+$', 0) AS token, count(*) AS n FROM part WHERE regexp_matches(p_name, '[a-z]+$') GROUP BY 1")
def scan_lines(spark, d):
    """Raw text lines, and the last word of each."""
    path = scratch_path(spark, "lines")
    writers.write_lines(table(spark, d, "part").select(F.concat(F.lit("part: "), "p_name").alias("value")), path)
    tokens = readers.read_lines(spark, path).select(first_match(C("value"), "[a-z]+$").alias("token"))
    return tokens.dropna().groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS balance FROM supplier WHERE s_nationkey < 12")
def scan_sheet(spark, d):
    """One worksheet of a workbook, by its two names; cells without a value say so."""
    folder = scratch_path(spark, "sheets")
    rows = table(spark, d, "supplier")
    balance = F.when(C("s_acctbal") >= 0, C("s_acctbal")).alias("balance")
    for name, part in (("North", C("s_nationkey") < 12), ("South", C("s_nationkey") >= 12)):
        writers.write_delimited(rows.filter(part).select("s_suppkey", "s_name", balance), f"{folder}/Suppliers 2020/{name}")
    return readers.read_sheet(spark, folder, "Suppliers 2020", "North", "s_suppkey bigint, s_name string, balance double")


@query("SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def scan_first_column(spark, d):
    chosen = table(spark, d, "customer").filter(C("c_mktsegment") == "BUILDING")
    return readers.first_column(chosen.select("c_name", "c_custkey", "c_acctbal"))
