"""Document fingerprints by order min hash: likeness that follows the edit distance, not just shared content.

Every k-mer of code points is numbered by its occurrence in the text. All (k-mer, number) pairs are hashed once
and dealt to bins by the leading bits; each bin selects its few pairs of least hash, puts them back into text
order and hashes the tuple. Two texts agree in a bin if they select the same pairs in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.llm.arrays import mixed, sliced

KMER = 8
BINS = 64
TUPLE = 2
BUCKET_BYTES = 16 << 20
COARSE = 64

_BASE = 0x9FB21C651E98DF25
_NUMBER = np.uint64(0xD1342543DE82EF95)
_FEW = 2_048


def _kmers(text: str) -> np.ndarray:
    """Hash of each k-mer; a shorter text is one k-mer, an empty one has none."""
    codes = mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    if len(codes) == 0:
        return codes
    width, goal = 1, min(KMER, len(codes))
    while width < goal:
        step = min(width, goal - width)
        codes = codes[: len(codes) - step] * np.uint64(pow(_BASE, step, 1 << 64)) + codes[step:]
        width += step
    return codes


def signature(text: str) -> np.ndarray:
    """One 32-bit value per bin; 0 where the bin has no k-mer."""
    kmers = _kmers(text)
    size = len(kmers)
    if size == 0:
        return np.zeros(BINS, np.uint32)
    bits = np.uint64(max(1, (size - 1).bit_length()))
    keys = np.sort((mixed(kmers) >> bits << bits) | np.arange(size, dtype=np.uint64))
    places = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    groups = keys >> bits
    index = np.arange(size)
    first = np.where(np.concatenate([[True], groups[1:] != groups[:-1]]), index, 0)
    number = (index - np.maximum.accumulate(first)).astype(np.uint64)
    hashes = mixed(kmers[places] + number * _NUMBER)
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    if size > _FEW:
        # only small hashes can be selected; the whole set is used if that leaves a bin short
        low = hashes << np.uint64(BINS.bit_length() - 1)
        few = low < np.uint64(int(2.0**64 * _FEW / 2 / size))
        chosen, at = _selected(hashes[few], places[few], edges)
        if (at >= 0).all():
            return _tuples(chosen, at)
    return _tuples(*_selected(hashes, places, edges))


def _selected(hashes: np.ndarray, places: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, places = hashes[order], places[order]
    begins = np.searchsorted(hashes, edges)
    ends = np.append(begins[1:], len(hashes))
    take = begins[:, None] + np.arange(TUPLE)
    there = take < ends[:, None]
    take = np.where(there, take, 0)
    if len(hashes) == 0:
        return np.zeros(take.shape, np.uint64), np.full(take.shape, -1)
    return np.where(there, hashes[take], 0), np.where(there, places[take], -1)


def _tuples(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    order = np.argsort(np.where(places < 0, np.iinfo(np.int64).max, places), axis=1, kind="stable")
    hashes = np.take_along_axis(hashes, order, 1)
    value = np.zeros(BINS, np.uint64)
    for i in range(TUPLE):
        value = mixed(value * _NUMBER + hashes[:, i])
    return np.where((places >= 0).any(axis=1), np.maximum(value >> np.uint64(32), np.uint64(1)), 0).astype(np.uint32)


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the bins in use that agree; 1 for two texts without any k-mer."""
    used = (a > 0) | (b > 0)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def written(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: str | Column, b: str | Column) -> Column:
    """`agreement` of two columns of fingerprints, as a Column expression."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.struct(a.substr(i * 8 + 1, F.lit(8)).alias("a"), b.substr(i * 8 + 1, F.lit(8)).alias("b"))
    )
    used = F.filter(parts, lambda p: (p["a"] != "0" * 8) | (p["b"] != "0" * 8))
    same = F.size(F.filter(used, lambda p: p["a"] == p["b"]))
    return F.when(F.size(used) == 0, 1.0).otherwise(same / F.size(used))


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text (missing: as empty) as hexadecimal text. Equal texts have equal
    fingerprints; a text shorter than a k-mer is one k-mer, an empty one has none. An input column called
    like the output is replaced. No shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            values = [written(signature(t or "")) for t in batch.column(text).to_pylist()]
            columns = {c: batch.column(c) for c in batch.schema.names} | {name: pa.array(values, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rest = df.drop(name)
    return rest.mapInArrow(add, rest.withColumn(name, F.lit("")).schema)


_COMPARED = (
    "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in _COMPARED.split(",")]
    held = None  # bucket, whether it only closes the bucket, id, text, signature
    rows, chars = [], 0
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def packed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for bucket, tail, name, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
            if tail and held is not None and held[1] and held[0] == bucket:
                continue
            own = signature(text)
            if held is not None and held[0] == bucket and not held[1]:
                _, _, before, base, values = held
                cut = len(base) // 2
                edited = base[: len(base) - cut] + text[:cut]
                changed = signature(edited)
                rows.append((before, len(base), edited, written(values), written(changed), agreement(values, changed), agreement(values, own)))
                chars += len(base)
                if chars > 1 << 21:
                    yield packed()
                    rows, chars = [], 0
            held = bucket, tail, name, text, own
    yield packed()


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, in which the last half (rounded down) of the
    code points is replaced by as many first ones, or all, of the next document in ascending doc_id (after
    the last one: the first), and their likeness to the text's own and to the next document's.

    Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next. A missing text
    is empty. Missing ids come first; rows with the same id stand in the order of their texts. A single
    document is its own next one. Other columns are left out; an empty table gives no rows.

    The texts are shuffled once: ids are cut into ranges (quantiles, then equal widths), and the first
    document of each range is sent to the range before as well. Tasks then stream the sorted rows.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    shares = F.array(*[F.lit(i / COARSE) for i in range(COARSE + 1)])
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("key", shares, F.lit(10_000)).alias("cuts")).first()
    cuts = sorted(set(size["cuts"] or [0]))
    fine = max(1, -(-(size["bytes"] or 0) // BUCKET_BYTES // COARSE))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    coarse = F.greatest(F.size(F.filter(bounds, lambda c: c <= F.col("key"))) - 1, F.lit(0))
    low = F.get(bounds, coarse).cast("double")
    high = F.coalesce(F.get(bounds, coarse + 1).cast("double"), low + 1)
    part = F.coalesce(F.try_divide(F.col("key").cast("double") - low, high - low), F.lit(0.0))
    within = F.floor(F.least(part, F.lit(1.0)) * fine)
    bucket = coarse * fine + F.least(F.greatest(within, F.lit(0)), F.lit(fine - 1)).cast("int")
    rows = rows.withColumn("bucket", bucket.cast("int"))
    # one row per range, that is per some MB of text
    firsts = sorted((r["bucket"], r["key"]) for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).collect())
    before = [(key, firsts[i - 1][0]) for i, (_, key) in enumerate(firsts)]
    closes = docs.sparkSession.createDataFrame(before, "key long, closes int")
    rows = rows.join(F.broadcast(closes), "key", "left")
    here = F.struct(F.col("bucket"), F.lit(False).alias("tail"))
    there = F.struct(F.col("closes").alias("bucket"), F.lit(True).alias("tail"))
    placed = F.when(F.col("closes").isNull(), F.array(here)).otherwise(F.array(here, there))
    placed = rows.select("doc_id", "key", "text", F.explode(placed).alias("at")).select("at.bucket", "at.tail", "key", "doc_id", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "tail", "key", "text").mapInArrow(_compare, _COMPARED)
