"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts (a sample of all) are needed. A linear model over the words of
a text is trained in numpy on a risk estimate corrected by the class prior: the share of positives hidden in
the unlabelled sample is taken off its negative risk, which is not allowed to fall below zero. Besides whole
words their beginnings count, so that inflected and compound forms are recognised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.llm.arrays import binaries, bucketed, flat, give_back, grouped, joined, pieces, sliced, word_hashes
from kinsieve.session import written

# bounds of the sample that the model is fitted on; everything else covers all rows
MOST_POSITIVE = 4_000
MOST_UNLABELLED = 12_000
DIMENSIONS = 1 << 21
PARTS = 16
PREFIXES = (4, 5, 6, 7)
LEAST_DOCUMENTS = 8
LEAST_LIFT = 2.0
STEPS = 300
RATE = 0.05
DECAY = 0.35
# hashing takes some 45 bytes per byte of text, in a worker per core
PIECE_BYTES = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256, dtype=np.uint64)
    code[ord("A") : ord("Z") + 1] += 32
    letter = np.zeros(256, bool)
    for low, high in (("a", "z"), ("A", "Z")):
        letter[ord(low) : ord(high) + 1] = True
    letter[128:] = True  # bytes of letters beyond ASCII
    return code + np.uint64(1), ~letter


_CODE, _GAP = _tables()


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each distinct word and word beginning of each text, ordered by row. Digits and punctuation part words.
    A text of more than PIECE_BYTES is hashed in pieces, cut between words."""
    data, offsets = flat(column)
    found = [np.zeros(0, np.uint64)]
    for part, ends, first in pieces(data, offsets, _GAP, PIECE_BYTES):
        hashes, rows = word_hashes(part, ends, _CODE, _GAP, PREFIXES)
        found.append(np.unique(((rows + first).astype(np.uint64) << np.uint64(32)) | (hashes % np.uint64(DIMENSIONS))))
    keys = np.unique(np.concatenate(found))
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", PIECE_BYTES):
        rows, found = features(batch.column("text"))
        ends = np.searchsorted(rows, np.arange(batch.num_rows), "right")
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("positive"), binaries(found.astype(np.uint32), ends)], names=["key", "positive", "words"]
        )


def _by_text(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Side of each text, row and feature of its words."""
    data, offsets = flat(batch.column("words"))
    positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    return positive, np.repeat(np.arange(len(positive)), np.diff(offsets) // 4), data.view(np.uint32)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts of each side that have each feature, for one task, by ranges of features."""
    counts = np.zeros((2, DIMENSIONS), np.int32)
    for batch in sliced(batches, "words"):
        positive, rows, found = _by_text(batch)
        for side in (0, 1):
            counts[side] += np.bincount(found[positive[rows] == side], minlength=DIMENSIONS).astype(np.int32)
    used = np.flatnonzero(counts.any(0))
    usual, seen = counts[:, used]
    yield bucketed(used // (DIMENSIONS // PARTS), {"feature": used.astype(np.uint32), "seen": seen, "usual": usual}, "part")
    del counts
    give_back()


def _lifted(n_positive: int, n_unlabelled: int):
    """Features in at least LEAST_DOCUMENTS positives (a word seen once would only name its text), and LEAST_LIFT
    times as frequent there as in unlabelled texts."""
    least = min(LEAST_DOCUMENTS, max(3, n_positive // 16))

    def chosen(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first = key[0].as_py() * (DIMENSIONS // PARTS)
        place = joined(table.column("feature"), np.uint32) - np.uint32(first)
        seen, usual = (np.bincount(place, joined(table.column(c), np.int32), DIMENSIONS // PARTS) for c in ("seen", "usual"))
        found = np.flatnonzero((seen / n_positive >= LEAST_LIFT * usual / n_unlabelled) & (seen >= least)) + first
        return pa.table({"feature": pa.array([found.astype(np.uint32).tobytes()], pa.binary())})

    return chosen


def _places(shared):
    """Of each text's features those in use, by their place among them."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(DIMENSIONS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value))
        for batch in sliced(batches, "words"):
            _, rows, found = _by_text(batch)
            found = place[found]
            ends = np.searchsorted(rows[found >= 0], np.arange(batch.num_rows), "right")
            words = binaries(found[found >= 0].astype(np.uint32), ends)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("positive"), words], names=["key", "positive", "words"])

    return places


def fit(is_pos: np.ndarray, row: np.ndarray, column: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights of the `size` features in use and the intercept, from the side of each text and the row and feature of
    each entry. The decay of the weights is DECAY over the number of positives."""
    n_all = len(is_pos)
    n_pos = int(is_pos.sum())
    share = np.where(is_pos, 1 / n_pos, 1 / (n_all - n_pos))
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    moments = np.zeros((2, size + 1))
    for step in range(1, STEPS + 1):
        score = np.bincount(row, w[column], n_all) + b
        chance = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        # logistic losses: positive -log(chance), negative -log(1 - chance)
        negative = -np.log1p(-np.minimum(chance, 1 - 1e-12)) * share
        hidden = negative[~is_pos].sum() - prior * negative[is_pos].sum()
        slope = np.where(is_pos, -prior * chance, chance) * share  # of the corrected negative risk
        if hidden < 0:
            slope = -slope  # step back from a negative risk that has gone below zero
        else:
            slope += np.where(is_pos, prior * (chance - 1) * share, 0)
        gradient = np.append(np.bincount(column, slope[row], size) + DECAY / n_pos * w, slope.sum())
        moments[0] += 0.1 * (gradient - moments[0])
        moments[1] += 0.001 * (gradient**2 - moments[1])
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)


def train(docs: DataFrame, confirmed: DataFrame, prior: float) -> tuple[np.ndarray, float]:
    """Fit on at most MOST_POSITIVE confirmed texts and about MOST_UNLABELLED of all texts: weights per feature and the
    intercept. Features that are too rare or not lifted have weight 0.

    Both are chosen by a hash of doc_id; `confirmed` holds the doc_id of confirmed toxic documents. Words are
    extracted where the texts are and counted by Spark; only entries of features in use come to the driver.
    """
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit("sample"))
    confirmed = confirmed.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    chosen = F.broadcast(confirmed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_POSITIVE).withColumn("positive", F.lit(True)))
    total = max(1, docs.count())
    share = min(1.0, MOST_UNLABELLED / total)
    drawn = F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", drawn.alias("drawn"), order.alias("key"))
    rows = rows.join(chosen, "doc_id", "left").filter(F.col("positive") | F.col("drawn"))
    # a confirmed text that is drawn as well stands on both sides
    side = F.explode(F.array_compact(F.array(F.when(F.col("positive"), True), F.when(F.col("drawn"), False))))
    schema = "key long, positive boolean, words binary"
    rows = written(rows.select("key", side.alias("positive"), "text").mapInArrow(_sample_features, schema), "sample")
    sides = dict(map(tuple, rows.groupBy("positive").count().collect()))
    weights = np.zeros(DIMENSIONS, np.float32)
    if len(sides) < 2:
        return weights, -20.0
    counted = rows.mapInArrow(_feature_counts, "part int, n long, feature binary, seen binary, usual binary")
    lifted = counted.groupBy("part").applyInArrow(grouped(_lifted(sides[True], sides[False])), "feature binary").collect()
    used = np.sort(np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(r["feature"], np.uint32) for r in lifted]]))
    found = rows.mapInArrow(_places(docs.sparkSession.sparkContext.broadcast(used)), schema).toArrow()
    # sums over texts are taken in the same order whatever the layout of the files
    found = found.sort_by([("positive", "descending"), ("key", "ascending"), ("words", "ascending")]).combine_chunks()
    w, b = fit(*_by_text(found), len(used), prior)
    weights[used] = w
    del found
    give_back()
    return weights, b


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability that each whole text is toxic; a missing or empty text scores by the intercept alone.
    An input column called like the output is replaced. No shuffle."""
    weights, base = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one fixed-size vector

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in sliced(batches, text, PIECE_BYTES):
            rows, found = features(batch.column(text))
            total = np.bincount(rows, weights[found], batch.num_rows) + base
            chance = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            columns = {c: batch.column(c) for c in batch.schema.names} | {name: pa.array(chance)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rest = docs.drop(name)
    return rest.mapInArrow(add, rest.withColumn(name, F.lit(0.0).cast("double")).schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for testing: a fifth by a checksum of the id; a missing id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """A model from the labels that are not held out: rows with toxic = 1 are the confirmed examples, and the
    share of toxic rows among the labelled ones is the class prior. Contradicting labels of one document count
    as toxic."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    return train(docs, known.filter(F.col("toxic") == 1), min(max(prior, 1e-3), 0.5))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document for toxicity; the columns of `docs` plus `score` and `predicted` (score >= 0.5).

    `labels` has doc_id and toxic (1, 0 or missing). Without any confirmed example all scores are about 0.
    Labels are no input of a score, and extra columns of either table change nothing; input columns called like
    the outputs are replaced. A missing text counts as empty, rows repeat as they come, and an empty table
    gives no rows.
    """
    scored = score(docs.drop("score", "predicted"), learn(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
