"""Writers: delimited text, text lines, Parquet snapshots."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_delimited(df: DataFrame, path: str, sep: str = ",", missing: str = "NA") -> None:
    """Delimited text with a header line and a token for missing values, one file per task."""
    df.write.option("header", True).option("sep", sep).option("nullValue", missing).option("emptyValue", "").csv(path)


def write_lines(df: DataFrame, path: str, header: str | None = None) -> None:
    """A frame of one string column as text lines, each file headed by the given line."""
    if header is None:
        df.write.text(path)
        return
    lines = df.toDF(header).write.option("header", True).option("sep", "\x01\x02\x03").option("quote", "")
    lines.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_snapshot(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Several named tables as one snapshot folder."""
    for name, df in tables.items():
        df.write.parquet(os.path.join(folder, name))
    names = list(tables)
    spark = tables[names[0]].sparkSession
    spark.createDataFrame([(n,) for n in names], "table_name string").write.parquet(os.path.join(folder, "_tables"))
