"""Centroid clustering with a Walsh-Hadamard progressive search.

Vectors and centroids are whole-numbered and transformed by an exact integer Walsh-Hadamard transform, which
multiplies squared distances by the width. Differences of coefficients are squared and added from coarse to fine;
a centroid whose partial sum already exceeds the whole distance of another one is strictly worse and drops out, the
others are finished over all coefficients. Sums per centroid add up exactly whatever the order of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from kinsieve.session import written

ROWS_AT_ONCE = 4_096
# whole numbers up to here keep every sum of squares of 64 coefficients within a long; beyond, Python integers do
NARROW = 1 << 23
LIMB = 10**18
LONGEST = (1 << 63) - 1

_PREPARED = "id long, coefficients binary, wide string"


def transform(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (its length a power of two), coarse coefficients first."""
    out = rows.copy()
    n, width = out.shape
    step = 1
    while step < width:
        pairs = out.reshape(n, width // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return out[:, _coarse_first(width)]


def _coarse_first(width: int) -> np.ndarray:
    """Coefficients by how often their sign pattern changes."""
    signs = np.ones((1, 1), np.int64)
    while len(signs) < width:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def restore(rows: np.ndarray) -> np.ndarray:
    """The inverse of `transform`: the transform is its own inverse up to the width."""
    width = rows.shape[1]
    back = np.empty_like(rows)
    back[:, _coarse_first(width)] = rows
    again = transform(back)
    plain = np.empty_like(again)
    plain[:, _coarse_first(width)] = again
    return plain // width


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (ties: the smaller) and `width` times the squared distance;
    both sides are transformed."""
    n, width = vectors.shape
    every = np.arange(n)
    total = np.zeros((n, len(centroids)), vectors.dtype)
    alive = np.ones(total.shape, bool)
    leader, bound = None, None
    done, level = 0, 1
    while True:
        rows, numbers = np.nonzero(alive)
        apart = vectors[rows, done:level] - centroids[numbers, done:level]
        total[rows, numbers] += (apart * apart).sum(axis=1)
        if level == width:
            break
        # a centroid that leads so far is finished at once: its whole distance bounds the least one
        ahead = np.where(alive, total, total.max() + 1).argmin(axis=1)
        fresh = every if leader is None else np.flatnonzero(ahead != leader)
        apart = vectors[fresh] - centroids[ahead[fresh]]
        whole = (apart * apart).sum(axis=1)
        if leader is None:
            bound = whole
        else:
            bound[fresh] = np.minimum(bound[fresh], whole)
        leader = ahead
        alive &= total <= bound[:, None]
        done, level = level, min(2 * level, width)
    total = np.where(alive, total, total.max() + 1)
    best = total.argmin(axis=1)
    return best, total[every, best]


def _whole(value: float, scale: int) -> int:
    """floor(value * scale), also where the product leaves the range of doubles."""
    return int(value) * scale if abs(value) >= 2.0**53 else math.floor(value * scale)


def _prepare(scale: int, width: int):
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = np.asarray(batch.column("vector").flatten(), np.float64).reshape(-1, width)
            small = np.abs(values).max(axis=1) * scale < NARROW
            rows = np.floor(np.where(small[:, None], values, 0.0) * scale).astype(np.int64)
            packed = transform(rows).astype("<i4")
            narrow = [packed[i].tobytes() if ok else None for i, ok in enumerate(small)]
            wide = [None if ok else ",".join(str(_whole(x, scale)) for x in values[i].tolist()) for i, ok in enumerate(small)]
            yield pa.record_batch(
                [batch.column("id"), pa.array(narrow, pa.binary()), pa.array(wide, pa.string())], ["id", "coefficients", "wide"]
            )

    return prepare


def _blocks(batch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and transformed vectors: the narrow rows as longs, then the wide ones as Python integers."""
    narrow = np.asarray(batch.column("coefficients").is_valid())
    rows = np.flatnonzero(narrow)
    for i in range(0, len(rows), ROWS_AT_ONCE):
        part = rows[i : i + ROWS_AT_ONCE]
        data = b"".join(batch.column("coefficients").take(pa.array(part)).to_pylist())
        yield part, np.frombuffer(data, "<i4").astype(np.int64).reshape(-1, width)
    rows = np.flatnonzero(~narrow)
    for i in range(0, len(rows), ROWS_AT_ONCE):
        part = rows[i : i + ROWS_AT_ONCE]
        texts = batch.column("wide").take(pa.array(part)).to_pylist()
        yield part, transform(np.array([[int(x) for x in t.split(",")] for t in texts], object))


def _assigned(batch, centroids: list[list[int]]):
    """Row numbers, transformed vectors, cluster and distance of the blocks of a batch."""
    width = len(centroids[0])
    exact = np.array(centroids, object)
    fits = np.abs(exact).max() < NARROW
    exact = transform(exact)
    longs = exact.astype(np.int64) if fits else None
    for rows, vectors in _blocks(batch, width):
        if fits and vectors.dtype != object:
            best, distance = nearest(vectors, longs)
        else:
            best, distance = nearest(vectors.astype(object), exact)
        yield rows, vectors, best, distance // width


def _limbs(value: int) -> list[int]:
    """The value as a sum of limbs times powers of LIMB, each limb a long."""
    found = []
    while not -LIMB < value < LIMB:
        value, rest = divmod(value, LIMB)
        found.append(rest)
    return [*found, value]


def _sum_up(centroids: list[list[int]]):
    """One row per centroid, coefficient and limb with the sum over the task; position -1 counts the vectors."""
    k, width = len(centroids), len(centroids[0])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((k, width), object)
        counts = np.zeros(k, object)
        for batch in batches:
            for _, vectors, best, _ in _assigned(batch, centroids):
                for number in np.unique(best):
                    own = vectors[best == number]
                    totals[number] += own.sum(axis=0)
                    counts[number] += len(own)
        rows = []
        for number in range(k):
            if counts[number]:
                for position, value in enumerate([int(counts[number]), *map(int, totals[number])], start=-1):
                    rows += [(number, position, place, limb) for place, limb in enumerate(_limbs(value))]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        names = ["cluster", "position", "place", "value"]
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return sum_up


def _assign(centroids: list[list[int]]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.zeros(batch.num_rows, np.int32)
            reach = np.zeros(batch.num_rows, np.int64)
            for rows, _, best, distance in _assigned(batch, centroids):
                cluster[rows] = best
                reach[rows] = np.minimum(distance, LONGEST).astype(np.int64)
            yield pa.record_batch([batch.column("id"), pa.array(cluster), pa.array(reach)], ["id", "cluster", "distance"])

    return assign


def _moved(prepared: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floored mean of each centroid's vectors; a centroid without vectors stays."""
    sums = prepared.mapInArrow(_sum_up(centroids), "cluster int, position int, place int, value long")
    sums = sums.groupBy("cluster", "position", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    width = len(centroids[0])
    totals: dict[int, list[int]] = {}
    # a bounded result: a row per centroid, coefficient and limb
    for cluster, position, place, value in sums.collect():
        totals.setdefault(cluster, [0] * (width + 1))[position + 1] += int(value) * LIMB**place
    moved = [list(c) for c in centroids]
    for cluster, (count, *sums_of) in totals.items():
        plain = restore(np.array([sums_of], object))[0]
        moved[cluster] = [int(x) // count for x in plain]
    return moved


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: str = "3:",
    id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    width: int = 64,
) -> DataFrame:
    """Each vector's cluster after `rounds` rounds: id, cluster, distance (squared), cluster_inertia, inertia,
    centroid (its components as text, joined by commas).

    Vectors of `width` components (a power of two) take part; one of another length, a missing one or one with a
    missing or non-finite component gives no row. Components are scaled and floored to whole numbers. Centroids
    start as the k vectors whose sha256 of `seed` and id is smallest, in that order (equal ids: by their
    components' bytes; a missing id comes last); with fewer vectors there are fewer clusters. Repeated rows count as often
    as they stand there. Empty input gives no rows; other columns are left out, so names cannot clash. Components
    of any size are exact; a distance or inertia beyond a long becomes the largest long.

    The transformed vectors are written once. Each round is one pass over them and an aggregate whose size depends
    on k and the width alone; only the centroids pass through the driver.
    """
    x = F.col("vector")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(x.isNotNull() & (F.size(x) == width) & fine)
    prepared = written(rows.mapInArrow(_prepare(scale, width), _PREPARED), "coefficients")

    name = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = prepared.orderBy(name.asc_nulls_last(), "coefficients", "wide").limit(k).collect()
    out = "id long, cluster int, distance long"
    if not first:
        spark = vectors.sparkSession
        columns = "cluster int, distance long, cluster_inertia long, inertia long, centroid string"
        return spark.createDataFrame([], T.StructType.fromDDL(f"`{id}` long, {columns}"))
    centroids = []
    for row in first:
        if row["wide"] is None:
            coefficients = np.frombuffer(row["coefficients"], "<i4").astype(np.int64)[None]
            centroids.append([int(v) for v in restore(coefficients)[0]])
        else:
            centroids.append([int(v) for v in row["wide"].split(",")])
    for _ in range(rounds):
        centroids = _moved(prepared, centroids)

    assigned = written(prepared.mapInArrow(_assign(centroids), out), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    whole = min(LONGEST, sum(int(row["sum"]) for row in sums))
    about = [
        (row["cluster"], min(LONGEST, int(row["sum"])), whole, ",".join(map(str, centroids[row["cluster"]]))) for row in sums
    ]
    # at most k rows
    about = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid string")
    joined = assigned.join(F.broadcast(about), "cluster")
    return joined.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
