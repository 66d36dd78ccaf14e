"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# What a session needs for the plans in this package. AQE splits skewed join partitions and turns a
# sort-merge join into a broadcast join only once the shuffled side has been measured.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call-site capture per expression: plans here are built from many small expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


_FOLDERS: set[str] = set()


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the recommended settings; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName("kinsieve")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. Only a local master, where driver and executors are one
    process, gets a temporary one instead; elsewhere executors would not see each other's files."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="kinsieve-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; two calls never collide. All paths of an application lie in one folder,
    which goes when the application ends."""
    folder = os.path.join(shared_dir(spark), "kinsieve", spark.sparkContext.applicationId)
    if folder not in _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS.add(folder)
    return os.path.join(folder, f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once below the shared folder and read it back: the lineage is cut and the result
    survives the loss of any executor, unlike a cached frame."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    # the schema is known, so no job is spent on reading it from the files
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_and_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """`written`, and the number of rows as observed while writing."""
    seen = Observation()
    frame = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return frame, seen.get["rows"]


# the stages of the result under construction, by the hash of their plan
_STAGES: ContextVar[dict[int, list[tuple[DataFrame, DataFrame]]] | None] = ContextVar("stages", default=None)


def shared(df: DataFrame, label: str) -> DataFrame:
    """`written`, but only once per plan: within a function marked `staged`, a frame built anew with the same plan is the stage
    that is there already. Outside, inputs may have changed since, so each call writes."""
    stages = _STAGES.get()
    if stages is None:
        return written(df, label)
    same = stages.setdefault(df.semanticHash(), [])
    for plan, stage in same:
        if plan.sameSemantics(df):
            return stage
    same.append((df, written(df, label)))
    return same[-1][1]


def staged(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let all that is built within the function, at any depth, share its stages."""

    @functools.wraps(function)
    def call(*args, **options) -> DataFrame:
        if _STAGES.get() is not None:
            return function(*args, **options)
        token = _STAGES.set({})
        try:
            return function(*args, **options)
        finally:
            _STAGES.reset(token)

    return call
