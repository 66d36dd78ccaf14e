"""A corpus pipeline over `documents`: five stages, each one operator of kinsieve.llm.

Toxic documents go, one document of each group of near duplicates stays (that of the smallest doc_id), passages
that an earlier document has as well are cut out, the rest is laid out in the mix of its sources, and tokens are
written in that order. Every stage works on all that its predecessor kept. Rows with a missing text pass through all stages
(they have no tokens), rows with a missing doc_id are nobody's duplicate. Of rows with the same doc_id and text one stays; a doc_id that
stands on several texts is several documents. Extra columns, whatever their names, are carried along unchanged up
to the last stage. Empty tables give no rows, very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsieve.llm import bpe, jaccard, mixing, suffixes, toxicity
from kinsieve.llm.queries import MIX_WEIGHTS, tokenizer_path
from kinsieve.operators.ordered import asc, with_index
from kinsieve.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# SQL cannot express the first stage (a trained model)
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the model is learnt from `docs` and the labels table."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, name="__toxicity").filter("__toxicity < 0.5").select(*docs.columns)


def set_aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """Rename all but the used columns, so that no output of an operator meets one of them; and the way back."""
    names = {f"extra_{i}": c for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed({c: n for n, c in names.items()}), names


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no smaller doc_id is linked to, directly or over others. Of rows that share doc_id and text one stays;
    other texts of one doc_id are judged apart, in the order of their checksums."""
    several = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    several = written(several, "several")
    if several.isEmpty():
        classes = jaccard.near_duplicates(docs.select("doc_id", "text"))
        copies = classes.filter("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    # a text without a value is told from an empty one; the checksum stands for the text where ids are numbered
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    rows = docs.withColumn("__digest", digest).join(several.withColumn("__several", F.lit(True)), "doc_id", "left")
    repeated = rows.filter("__several").dropDuplicates(["doc_id", "__digest"])
    rows = written(rows.filter("__several IS NULL").unionByName(repeated).drop("__several"), "apart")
    # every further text of an id gets a number of its own, beyond all ids
    keys = rows.join(several, "doc_id", "left_semi").select("doc_id", "__digest")
    keys = with_index(keys, [asc("__digest")], ["doc_id"], name="__place")
    further = with_index(keys.filter("__place > 1").drop("__place"), [asc("doc_id"), asc("__digest")], name="__number")
    least, last = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.col("__number") + last if last < 1 << 62 else F.lit(least) - F.col("__number")
    named = written(further.select("doc_id", "__digest", number.alias("__name")), "further")
    rows = rows.join(named, ["doc_id", "__digest"], "left").withColumn("__name", F.coalesce("__name", "doc_id"))
    found = jaccard.near_duplicates(rows.select(F.col("__name").alias("doc_id"), "text"))
    classes = written(found.select(F.col("doc_id").alias("__name"), "component_id"), "classes")
    classes = classes.join(named.select("__name", F.col("doc_id").alias("__true")), "__name", "left")
    classes = classes.withColumn("__true", F.coalesce("__true", "__name"))
    # the smallest doc_id of a class stays; of its texts the first
    first = classes.groupBy("component_id").agg(F.min(F.struct("__true", "__name"))["__name"].alias("__first"))
    copies = classes.join(first, "component_id").filter("__name <> __first").select("__name")
    return rows.join(copies, "__name", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has as well; half a character left by a cut is replaced. A missing text
    stays missing, equal rows lose the same."""
    rows, names = set_aside(docs, ("doc_id", "text", "n_chars"))
    found = suffixes.remove_repeats(rows.withColumn("__missing", F.col("text").isNull()))
    text = F.when(~F.col("__missing"), F.make_valid_utf8(F.col("kept").cast("string")))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.withColumnsRenamed(_free(found, names)).select(*docs.columns)


def _free(df: DataFrame, names: dict[str, str]) -> dict[str, str]:
    """The way back for columns that were set aside; outputs that bear their names make room."""
    return {c: f"__out_{c}" for c in df.columns if c in names.values()} | names


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones too, laid out in the order of the mix."""
    rows, names = set_aside(docs, ("doc_id", "source"))
    return mixing.in_mixed_order(rows, MIX_WEIGHTS).withColumnsRenamed(names).select(*docs.columns)


def placed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with `position`, the number of each row in the order of files and of the rows in them. A scan
    deals out files by size, so that order is lost unless it is read from the files. A frame that is no plain
    scan is written first."""
    file = F.col("_metadata.file_name")
    try:
        docs.select(file)
    except AnalysisException:
        docs = written(docs, "placed")
    # one row per file comes to the driver
    counts = sorted(map(tuple, docs.groupBy(file.alias("__file")).agg(F.count("*")).collect()))
    before = [(name, rows) for (name, _), rows in zip(counts, accumulate((n for _, n in counts), initial=0), strict=False)]
    before = spark.createDataFrame(before, "__file string, __before long")
    rows = docs.select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    rows = rows.join(before, "__file")
    return rows.withColumn("position", F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed unsigned 32-bit integers), and whether they decode to it, laid out by the
    position in the mix. Repeated rows have a row each; further columns end here."""
    path = tokenizer_path()
    rows = placed(spark, docs).select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"), "position")
    rows = rows.repartitionByRange("position").sortWithinPartitions("position")
    # decoded texts are compared by checksum, so that texts need not come back from the Python workers
    both = bpe.encode_and_decode(rows.withColumn("digest", F.sha2("text", 256)), path)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return both.select("doc_id", "lang", "source", n_tokens, "ids", (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"), "position")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages before it return is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
