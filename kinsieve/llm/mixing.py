"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source of weight w (of a total W) owns the fraction w / W of all slots. Its block number j (from 0) may not
run before slot floor(j W / w), its release, and must have run by slot ceil((j + 1) W / w), its deadline. In
every slot the released block with the earliest deadline runs. Then each source is always less than one block
away from its share. The schedule repeats after W slots, so W slots are computed once, whatever the number of
documents, and every block's slot follows from its number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

BLOCK_ROWS = 32
BUCKET_ROWS = 5_000

# one slot: release and deadline of each source's next block, the earliest deadline wins (ties: first source)
_SLOT = """
aggregate(
    sequence(0, total - 1),
    named_struct('runs', array_repeat(0, size(members)), 'picks', cast(array() as array<int>)),
    (done, slot) -> transform(
        array(array_min(transform(members, (m, i) -> if(
            (done.runs[i] * total) div m.weight <= slot,
            named_struct('deadline', ((done.runs[i] + 1) * total + m.weight - 1) div m.weight, 'pick', i),
            null
        ))).pick),
        pick -> named_struct(
            'runs', transform(done.runs, (r, i) -> if(i = pick, r + 1, r)),
            'picks', concat(done.picks, array(pick))
        )
    )[0],
    done -> done.picks
)
"""


def schedule(sources: DataFrame) -> DataFrame:
    """Slots of one period: source, weight, total, slots (of the source's blocks, in order).

    `sources` has one row per source with its whole weight. The list of sources meets in one row: the number
    of sources and the sum of weights are parameters of the mix, not sizes of the data.
    """
    members = sources.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "weight"))).alias("members"), F.sum("weight").cast("int").alias("total"))
    picks = members.filter("total > 0").withColumn("picks", F.expr(_SLOT))
    slots = picks.select("members", "total", F.posexplode("picks").alias("slot", "pick"))
    slots = slots.select(F.expr("members[pick]").alias("m"), "total", "slot")
    return slots.groupBy("m", "total").agg(F.array_sort(F.collect_list("slot")).alias("slots")).select("m.source", "m.weight", "total", "slots")


def mix(
    docs: DataFrame, weights: Mapping[str, int], other: int = 1, block_rows: int = BLOCK_ROWS, key: str = "doc_id", source: str = "source"
) -> DataFrame:
    """All rows of `docs` with their place in the mix: block, slot, release, deadline, position.

    `weights` are whole numbers of at least 1; sources it does not name, a missing source among them, have the
    weight `other` each. Rows of a source are cut into blocks of `block_rows` in a pseudo-random order that
    follows from the key. No row is dropped: when a source has run out its slots stay empty, and the others go
    on in their proportions. `position` orders the mix: all rows of a slot, then those of the next. Rows that
    repeat a key stand in any order among themselves. Input columns called like the outputs are replaced. An
    empty table gives no rows.

    Rows are numbered within (source, bucket) pairs of bounded size plus the counts of the buckets before, so
    a source with a third of all rows is numbered by many tasks.
    """
    if min([*weights.values(), other, block_rows]) < 1:
        raise ValueError("weights and block_rows are at least 1")
    rows = docs.drop("block", "slot", "release", "deadline", "position", "__bucket", "__source")
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    name = F.to_json(F.struct(F.col(source).cast("string").alias("s")))  # tells a missing source from an empty one
    hashed = F.xxhash64(F.col(key), F.lit("mix"))
    rows = rows.withColumns({"__source": name, "__bucket": F.pmod(hashed, F.lit(buckets)).cast("int")})
    counts = rows.groupBy("__source", "__bucket", F.col(source).cast("string").alias("__name")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    given = F.lit(other)
    for s, w in weights.items():
        given = F.when(F.col("__name") == s, F.lit(w)).otherwise(given)
    plan = schedule(counts.select("__source", given.cast("long").alias("weight")).distinct().withColumnRenamed("__source", "source"))
    plan = counts.select("__source", "__bucket", "__before").join(plan.withColumnRenamed("source", "__source"), "__source")
    within = Window.partitionBy("__source", "__bucket").orderBy(hashed, key)
    numbered = rows.withColumn("__row", F.row_number().over(within)).join(plan, ["__source", "__bucket"])
    index = F.col("__before") + F.col("__row") - 1
    at = {"__index": index, "block": F.floor(index / block_rows)}
    cycle, turn = F.expr("block div weight"), F.expr("cast(block % weight as int)")
    numbered = numbered.withColumns(at).withColumns(
        {
            "slot": cycle * F.col("total") + F.get("slots", turn),
            "release": F.expr("(block * total) div weight"),
            "deadline": F.expr("((block + 1) * total + weight - 1) div weight"),
        }
    )
    numbered = numbered.withColumn("position", F.col("slot") * block_rows + F.col("__index") % block_rows)
    return numbered.select(*[c for c in rows.columns if not c.startswith("__")], "block", "slot", "release", "deadline", "position")


def in_mixed_order(docs: DataFrame, weights: Mapping[str, int], **options) -> DataFrame:
    """The rows of `docs`, unchanged, laid out so that files and the rows within them follow the mix."""
    mixed = mix(docs, weights, **options)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)
