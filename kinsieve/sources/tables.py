"""Readers: delimited and whitespace text, raw lines, Parquet snapshots, database tables, literals."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


# no line holds this, so a line is one field
_WHOLE_LINE = "\x01\x02\x03"


def read_parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def read_snapshot(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The named tables of a snapshot written by `write_snapshot`."""
    if names is None:
        names = [r.table_name for r in spark.read.parquet(os.path.join(folder, "_tables")).collect()]
    return {n: spark.read.parquet(os.path.join(folder, n)) for n in names}


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    columns: Sequence[str] | None = None,
    sep: str = ",",
    missing: str = "NA",
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text with a declared schema; only the selected columns are parsed.

    `multi_line` lets quoted fields hold line breaks. A file is then read by one task, as a cut anywhere in it could lie within
    a field: hand over several files where the text is large. Quotes are escaped by doubling them there.
    """
    reader = spark.read.schema(schema).option("header", header).option("sep", sep).option("nullValue", missing)
    if multi_line:
        reader = reader.option("escape", '"')
    df = reader.option("multiLine", multi_line).csv(path)
    return df.select(*columns) if columns else df


def read_sheet(
    spark: SparkSession,
    folder: str,
    workbook: str,
    worksheet: str,
    schema: StructType | str,
    missing: str = "NA",
    multi_line: bool = False,
) -> DataFrame:
    """A worksheet exported as delimited text under folder/workbook/worksheet."""
    return read_delimited(spark, os.path.join(folder, workbook, worksheet), schema, missing=missing, multi_line=multi_line)


def read_before_trailer(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, tuple[int, str]],
    is_trailer: Column,
    sep: str = ",",
) -> DataFrame:
    """Delimited lines up to the first trailer marker of each file.

    `columns` maps names to (position, type); `is_trailer` is a condition on the column `value`. The
    marker's position comes from one aggregate per file, so no row cap has to be known. Lines are cut first
    and parsed as delimited text afterwards, so fields may be quoted and `sep` is taken literally.
    """
    lines = spark.read.text(path).select(
        "value",
        F.monotonically_increasing_id().alias("__at"),
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
    )
    position = F.struct(F.col("__block"), F.col("__at"))
    marks = lines.filter(is_trailer).groupBy("__file").agg(F.min(position).alias("__cut"))
    kept = lines.join(marks, "__file", "left").filter(F.col("__cut").isNull() | (position < F.col("__cut")))
    width = max(i for i, _ in columns.values()) + 1
    fields = F.from_csv("value", ", ".join(f"f{i} string" for i in range(width)), {"sep": sep})
    kept = kept.select(fields.alias("fields"))
    return kept.select(*[F.col("fields")[f"f{i}"].try_cast(kind).alias(n) for n, (i, kind) in columns.items()])


def read_whitespace(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Whitespace-separated text; `columns` gives name and type of each field. The first line of each file is
    its header and is left out, whatever it says."""
    lines = spark.read.schema("value string").option("header", True).option("sep", _WHOLE_LINE).option("quote", "").csv(path)
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value") != "").select(fields.alias("f"))
    rows = rows.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(columns)])
    return rows.select(*[F.when(F.col(n) != "NA", F.col(n)).try_cast(kind).alias(n) for n, kind in columns.items()])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; filters and column choice on the result are pushed into the query."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table written out in code."""
    return spark.createDataFrame(list(rows), schema)


def first_column(df: DataFrame) -> DataFrame:
    return df.select(df.columns[0])
