"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot holds one bit per language, and the bitwise and of an
n-gram's slots gives all languages that contain it. A text's language is decided by the popcount per language
over its n-grams, corrected for the false positives to be expected from how full each language's slice is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.llm.arrays import binaries, bucketed, joined, mixed, sliced
from kinsieve.session import written

GRAM = 4
LEAST_SLOTS = 1 << 22
MOST_SLOTS = 1 << 26
FULLEST = 0.3
HASHES = 2
PARTS = 64
LEAST_SEEN = 3
LEAST_SHARE = 0.34
LEARN_BYTES = 6 << 20

_BASE = np.uint64(0x9FB21C651E98DF25)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, a space otherwise."""
    codes = np.arange(0x110000, dtype=np.uint32)
    letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    return np.where(letter, codes, 32).astype(np.uint32)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every n-gram of letters and single word gaps, in text order."""
    parts = [f" {t.lower()} " for t in texts]
    codes = _letters()[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = codes == 32
    twice = np.zeros(len(codes), bool)
    twice[1:] = gap[1:] & gap[:-1]
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    # runs of gaps shrink to one; each text keeps its own first gap
    keep = ~twice
    keep[np.cumsum([0, *[len(p) for p in parts]])[:-1][: len(parts)]] = True
    codes, rows = codes[keep].astype(np.uint64), rows[keep]
    size = max(0, len(codes) - GRAM + 1)
    value = np.zeros(size, np.uint64)
    gaps = np.zeros(size, np.int8)
    for i in range(GRAM):
        value = value * _BASE + mixed(codes[i : i + size])
        gaps += codes[i : i + size] == 32
    whole = (rows[:size] == rows[GRAM - 1 :][:size]) & (gaps < GRAM - 1)
    return rows[:size][whole], mixed(value[whole])


def _slots(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    return [((hashes >> np.uint64(32 * i)) % np.uint64(size)).astype(np.int64) for i in range(HASHES)]


def _counted(languages: list[str], buckets: int):
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", LEARN_BYTES):
            rows, hashes = grams(batch.column("text").to_pylist())
            owner = np.array([place[x] for x in batch.column("lang").to_pylist()])[rows]
            for i in np.unique(owner):
                found, counts = np.unique(hashes[owner == i], return_counts=True)
                columns = {"grams": found, "counts": counts.astype(np.uint32), "langs": np.full(len(found), i, np.uint16)}
                yield bucketed((found >> np.uint64(40)) % np.uint64(buckets), columns)

    return count


LEVELS = 40  # doublings of LEAST_SEEN that are told apart


def _chosen(totals: list[float]):
    """Languages of each n-gram: seen often enough, and not much rarer than in the language where it is most
    common. Each has a level: 0 if it has not the n-gram, 1 from LEAST_SEEN on, one more for every doubling."""

    def choose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found, index = np.unique(joined(table.column("grams"), np.uint64), return_inverse=True)
        langs, counts = joined(table.column("langs"), np.uint16), joined(table.column("counts"), np.uint32)
        seen = np.bincount(index * len(totals) + langs, counts, len(found) * len(totals)).reshape(-1, len(totals))
        rate = seen / np.maximum(np.array(totals), 1)
        has = (seen >= LEAST_SEEN) & (rate >= LEAST_SHARE * rate.max(axis=1, keepdims=True))
        levels = np.where(has, np.clip(1 + np.floor(np.log2(np.maximum(seen, 1) / LEAST_SEEN)), 1, LEVELS), 0).astype(np.uint8)
        used = has.any(axis=1)
        sizes = [np.bincount(x, minlength=LEVELS + 1)[1:] for x in levels.T]
        columns = {"grams": found[used], "levels": levels[used].view(f"V{len(totals)}").ravel(), "sizes": np.concatenate(sizes).astype(np.int64)}
        return pa.table([binaries(x, [len(x)]) for x in columns.values()], names=list(columns))

    return choose


def _sized(sizes: np.ndarray) -> tuple[int, np.ndarray]:
    """Slots of the filter, and the least level of each language, from the number of n-grams per language and
    level: as many slots (a power of two) as keep every language's slice at most FULLEST full. Where MOST_SLOTS
    would not do, the rarer n-grams of that language are left out, so its least rate rises."""
    slots, room = LEAST_SLOTS, -np.log(1 - FULLEST) / HASHES
    above = np.cumsum(sizes[:, ::-1], axis=1)[:, ::-1]  # n-grams of at least each level
    while slots < MOST_SLOTS and above[:, 0].max() > slots * room:
        slots *= 2
    return slots, 1 + (above > slots * room).sum(axis=1)


def _placed(slots: int, least: np.ndarray):
    """Slots and languages of the n-grams, dealt to the parts of the filter."""
    width = -(-len(least) // 8)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, levels in zip(batch.column("grams"), batch.column("levels"), strict=True):
                found = np.frombuffer(grams.as_py(), np.uint64)
                has = np.frombuffer(levels.as_py(), np.uint8).reshape(-1, len(least)) >= least
                used = has.any(axis=1)
                at = np.concatenate(_slots(found[used], slots))
                masks = np.concatenate([np.packbits(has[used], axis=1, bitorder="little")] * HASHES)
                yield bucketed(at // (slots // PARTS), {"slots": at, "masks": np.ascontiguousarray(masks).view(f"V{width}").ravel()}, "part")

    return place


def _merged(size: int, width: int):
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        slots = joined(table.column("slots"), np.int64) % size
        masks = joined(table.column("masks"), np.uint8).reshape(-1, width)
        part = np.zeros((size, width), np.uint8)
        np.bitwise_or.at(part, slots, masks)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([part.tobytes()], pa.binary())})

    return merge


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of `docs` (columns text and lang) and their common filter, from all rows with both.

    The n-grams are counted first and the filter is sized from that count, up to MOST_SLOTS slots of one bit
    per language; its parts are put together by tasks and only they come to the driver. The list of languages
    is taken to be short.
    """
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).cast("double").alias("chars")).orderBy("lang").collect()
    languages, totals = [r["lang"] for r in sizes], [r["chars"] for r in sizes]
    width = -(-len(languages) // 8) or 1
    if not languages:
        return languages, np.zeros((LEAST_SLOTS, width), np.uint8)
    buckets = max(8, int(sum(totals) // (64 << 20)))
    counted = rows.mapInArrow(_counted(languages, buckets), "bucket int, n long, grams binary, counts binary, langs binary")
    chosen = written(counted.groupBy("bucket").applyInArrow(_chosen(totals), "grams binary, levels binary, sizes binary"), "grams")
    found = np.zeros((len(languages), LEVELS), np.int64)
    for row in chosen.select("sizes").toLocalIterator():
        found += np.frombuffer(row["sizes"], np.int64).reshape(found.shape)
    slots, least = _sized(found)
    bits, step = np.zeros((slots, width), np.uint8), slots // PARTS
    placed = chosen.select("grams", "levels").mapInArrow(_placed(slots, least), "part int, n long, slots binary, masks binary")
    for row in placed.groupBy("part").applyInArrow(_merged(step, width), "part int, bits binary").toLocalIterator():
        bits[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["bits"], np.uint8).reshape(-1, width)
    return languages, bits


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row by its whole text.

    `und` with score 0 if the text is missing or has no letter, or if no language is known; otherwise the
    language with the most n-grams after the correction, ties to the first in alphabetical order. The score
    is its share of the corrected counts (an equal share if no n-gram is known). Input columns called like
    the outputs are replaced. No shuffle.
    """
    languages, bits = model
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # of bounded size
    filled = np.array([((bits[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    false = filled**HASHES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in sliced(batches, text):
            texts = batch.column(text).to_pylist()
            lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
            rows, hashes = grams([t or "" for t in texts])
            size = np.bincount(rows, minlength=len(texts)).astype(float)
            first, *others = _slots(hashes, len(bits))
            masks = bits[first]
            for slots in others:
                masks &= bits[slots]
            counts = np.zeros((len(texts), len(languages)))
            for i in range(len(languages)):
                hits = np.bincount(rows, (masks[:, i // 8] >> (i % 8)) & 1, len(texts))
                counts[:, i] = np.maximum(0, (hits - size * false[i]) / max(1e-9, 1 - false[i]))
            total = counts.sum(axis=1)
            best = counts.argmax(axis=1) if languages else np.zeros(len(texts), int)
            names, scores = [], []
            for i, fine in enumerate(lettered):
                known = fine and bool(languages)
                names.append(languages[best[i]] if known else "und")
                scores.append((counts[i, best[i]] / total[i] if total[i] > 0 else 1 / len(languages)) if known else 0.0)
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns |= {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rest = docs.drop("lang_pred", "score")
    schema = rest.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0).cast("double")).schema
    return rest.mapInArrow(add, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for testing: a third by a checksum of the id; a missing id is neither held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    model = learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
