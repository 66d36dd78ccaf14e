"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# values of one side of a tile, and most rows of it: 32 MB as doubles
TILE_VALUES = 1 << 22
TILE_ROWS = 8_192
QUERIES_AT_ONCE = 256
FAN_IN = 32

_FOUND = "query_id long, vec_id long, score long, shard int"


def _vectors(table: pa.Table, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-numbered vectors by vector length; ids ascend."""
    column = table.column("vector").combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    values = np.floor(np.asarray(column.flatten()).astype(np.float64) * scale)
    ids = np.asarray(table.column("id"))
    begins = np.cumsum(lengths) - lengths
    found = {}
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        found[int(length)] = ids[rows], values[begins[rows][:, None] + np.arange(length)].reshape(len(rows), length)
    return found


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows. Doubles hold them while all partial sums stay below 2**53;
    beyond, Python integers do, and a score outside the range of a long becomes its nearest end."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if bound < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    limits = np.iinfo(np.int64)
    return np.clip(whole(queries) @ whole(vectors).T, limits.min, limits.max).astype(np.int64)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best scores of each row; ties go to the smaller column."""
    size = scores.shape[1]
    if size > k:
        least = np.partition(scores, size - k, axis=1)[:, size - k]
        rows, columns = np.nonzero(scores >= least[:, None])
    else:
        rows, columns = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((columns, -scores[rows, columns].astype(np.float64), rows))
    # doubles may merge neighbouring huge scores; a second, exact pass within them keeps the order right
    values = scores[rows, columns]
    if np.abs(values).max(initial=0) >= 2**53:
        order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -int(values[i]), columns[i])), np.int64)
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[place < k], columns[place < k]


def _tile(k: int, scale: int):
    def product(key, shard: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if shard.num_rows and asked.num_rows:
            vectors = _vectors(shard, scale)
            for length, (query_ids, queries) in _vectors(asked, scale).items():
                ids, values = vectors.get(length, (np.zeros(0, np.int64), np.zeros((0, length))))
                for i in range(0, len(query_ids) if len(ids) else 0, QUERIES_AT_ONCE):
                    names = query_ids[i : i + QUERIES_AT_ONCE]
                    scores = _scores(queries[i : i + QUERIES_AT_ONCE], values)
                    own = names[:, None] == ids[None, :]
                    scores[own] = np.iinfo(np.int64).min
                    rows, columns = _best(scores, k)
                    other = ~own[rows, columns]
                    rows, columns = rows[other], columns[other]
                    found.append((names[rows], ids[columns], scores[rows, columns]))
        query_ids, ids, scores = map(np.concatenate, zip(*found, strict=True))
        return pa.table(
            {
                "query_id": query_ids.astype(np.int64),
                "vec_id": ids.astype(np.int64),
                "score": scores.astype(np.int64),
                "shard": np.full(len(ids), key[0].as_py(), np.int32),
            }
        )

    return product


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = 1024
) -> DataFrame:
    """The k vectors of highest score for each query, exactly: query_id, rank (from 1), vec_id, score.

    Components are scaled and floored to whole numbers, the score is their inner product, ties go to the
    smaller id. Rows with a missing id, a missing vector or a missing or non-finite component take no part;
    vectors of another length than the query's are not compared with it. A row is no candidate for the query
    of its own id. A query id that repeats asks once, with its smallest vector; a candidate id that repeats
    takes a rank for each row. Empty inputs give no rows; other columns are left out.

    Query blocks meet shards in tiles of bounded size: both sides are dealt to (shard, block) cells by a hash
    of the id, each tile keeps k candidates per query, and lists are merged in a tree of bounded fan-in, so
    that no task ever holds more than one tile or a few lists.
    """

    def usable(df: DataFrame) -> DataFrame:
        x = F.col("vector")
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
        return rows.filter(F.col("id").isNotNull() & x.isNotNull() & fine)

    candidates, asked = usable(vectors), usable(queries)
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    size = candidates.agg(F.count("*").alias("rows"), F.max(F.size("vector")).alias("width")).first()
    n_asked = usable(queries).count()
    side = max(1, min(TILE_ROWS, TILE_VALUES // max(1, size["width"] or 1)))
    shards, blocks = max(1, -(-size["rows"] // side)), max(1, -(-n_asked // side))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn("shard", dealt(shards)).withColumn("block", every(blocks))
    right = asked.withColumn("block", dealt(blocks)).withColumn("shard", every(shards))
    lists = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_tile(k, scale), _FOUND)
    while True:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        keys = ["query_id"] if shards == 1 else ["query_id", "shard"]
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
        lists = lists.withColumn("rank", place).filter(F.col("rank") <= k)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
