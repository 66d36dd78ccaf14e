"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row per document and a column per n-gram. Its product with its own transpose holds the
overlap counts of all pairs, of which only those matter that can reach the threshold:

1. A fixed-size table of approximate document frequencies puts all n-grams in one order, rare ones first.
2. Two sets of the wanted likeness share some n-grams among the first few of each: one, if each gives as many as its
   size allows to miss, and one; a few more, if each gives a few more. Only these entries are dealt to blocks of
   n-grams. Within a block, documents that share an n-gram and whose sizes are close enough are paired and counted;
   pairs that share too few n-grams over all blocks can not be linked. Where very many share one, they are tied in a chain
   instead. The components of these ties hold all links.
3. Each component, in blocks of bounded size, is multiplied out on whole sets: overlaps are accumulated per
   row of the product, pairs below the bound are discarded, and rows whose links would join nothing new are
   skipped. Equal sets are one row. The links' components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsieve.llm.arrays import binaries, flat, give_back, grouped, joined, mixed, sliced, spans, word_hashes
from kinsieve.llm.components import connected
from kinsieve.session import written

WORDS = 5
PERCENT = 80
TABLE_BITS = 24
TABLE_PARTS = 64
# n-grams that a pair has to share among the first ones of its sets: a number, and one more for so many n-grams of the set
MATCHES = 3
MATCH_SHARE = 50
BLOCK_ENTRIES = 4 << 20
# documents of one n-gram are paired up to so many pairs a document, beyond that tied in a chain
PAIRS = 16
ENOUGH = 1 << 30
TILE_ENTRIES = 2 << 20
FILTER_BITS = 26
FILTER_PARTS = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256, dtype=np.uint64)
    code[ord("A") : ord("Z") + 1] += 32
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    return code + np.uint64(1), gap


_CODE, _GAP = _tables()
_PLACE = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word n-grams of each text, ascending within a row, and the offsets of the rows.
    A text with fewer words has its whole sequence as its only one."""
    data, offsets = flat(column)
    words, rows = word_hashes(data, offsets, _CODE, _GAP)
    size = len(offsets) - 1
    if len(words) == 0:
        return words, np.zeros(size + 1, np.int64)
    counts = np.bincount(rows, minlength=size)
    last = np.cumsum(counts)
    value = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    left = np.repeat(last, counts) - np.arange(len(words))  # words from here to the end of the text
    for i in range(WORDS):
        value += np.where(left > i, mixed(padded[i : i + len(words)] * _PLACE[i]), 0)
    first = np.repeat(last - counts, counts) == np.arange(len(words))
    whole = (left >= WORDS) | first
    value, rows = mixed(value[whole]), rows[whole]
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    value, rows = value[fresh], rows[fresh]
    return value, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts per cell of the frequency table, for one task."""
    cells = np.zeros(1 << TABLE_BITS, np.uint16)
    for batch in sliced(batches, "text"):
        value, _ = shingle_sets(batch.column("text"))
        found, counts = np.unique((value >> np.uint64(64 - TABLE_BITS)).astype(np.int64), return_counts=True)
        cells[found] = np.minimum(cells[found].astype(np.int64) + counts, 65_535)
    size = (1 << TABLE_BITS) // TABLE_PARTS
    rows = []
    for part in range(TABLE_PARTS):
        counts = cells[part * size : (part + 1) * size]
        used = np.flatnonzero(counts)
        if len(used):
            gaps, counts = np.diff(used, prepend=0), counts[used]
            planes = (gaps & 255).astype(np.uint8), (gaps >> 8).astype(np.uint32), (counts & 255).astype(np.uint8), (counts >> 8).astype(np.uint8)
            rows.append((part, *[x.tobytes() for x in planes]))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    arrays = [pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(columns)]
    yield pa.RecordBatch.from_arrays(arrays, names=["part", "gap_low", "gap_high", "count_low", "count_high"])
    del cells, rows, columns, arrays
    give_back()


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros((1 << TABLE_BITS) // TABLE_PARTS)
    for row in table.to_pylist():
        gaps, counts = (np.frombuffer(row[f"{x}_low"], np.uint8) + (np.frombuffer(row[f"{x}_high"], k).astype(np.int64) << 8) for x, k in (("gap", np.uint32), ("count", np.uint8)))
        total[np.cumsum(gaps)] += counts
    coded = np.minimum(255, np.round(16 * np.log2(1 + total))).astype(np.uint8)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "coded": pa.array([coded.tobytes()], pa.binary())})


def frequencies(docs: DataFrame) -> np.ndarray:
    """Approximate document frequency (log scale) by the leading bits of an n-gram's hash, over all texts.

    The table has the same size for any corpus. It only decides the order of n-grams, so collisions cost time,
    never a link. Tasks count, tasks add up the parts; the driver receives the parts.
    """
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    size = len(table) // TABLE_PARTS
    counted = docs.select("text").mapInArrow(_counts, "part int, gap_low binary, gap_high binary, count_low binary, count_high binary")
    for row in counted.groupBy("part").applyInArrow(grouped(_summed), "part int, coded binary").toLocalIterator():
        table[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["coded"], np.uint8)
    return table


def _least_overlap(size: np.ndarray) -> np.ndarray:
    return -(-PERCENT * size // 100)


def _needed(size: np.ndarray) -> np.ndarray:
    """How many n-grams a linked set of this size or more shares with it among the first ones of both. Each set gives as many
    as it may miss and these; the first common ones, in the order of all n-grams, then lie among those of both."""
    return np.minimum(_least_overlap(size), MATCHES + size // MATCH_SHARE)


def _set_key(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash per set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(0x5555)), dtype=np.uint64)])
    return mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _set_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        values, offsets = shingle_sets(batch.column("text"))
        sizes = np.diff(offsets).astype(np.int64)
        arrays = [batch.column("doc_id"), pa.array(sizes), pa.array(_set_key(values, offsets).view(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "key"])


def _prefix_entries(shared, buckets: int):
    """Entries of the incidence matrix that can show a link, dealt to blocks of n-grams. Of equal sets in one
    piece of input only the smallest document's goes on."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in sliced(batches, "text"):
            values, offsets = shingle_sets(batch.column("text"))
            docs = np.asarray(batch.column("doc_id"))
            sizes = np.diff(offsets)
            _, head = np.unique(_set_key(values, offsets)[np.argsort(docs, kind="stable")], return_index=True)
            kept = np.zeros(len(docs), bool)
            kept[np.argsort(docs, kind="stable")[head]] = True
            rows = np.repeat(np.arange(len(docs)), sizes)
            rows, grams = rows[kept[rows]], values[kept[rows]]
            if len(grams) == 0:
                continue
            rank = table[grams >> np.uint64(64 - TABLE_BITS)]
            order = np.lexsort((grams, rank, rows))
            rows, grams = rows[order], grams[order]
            begins = np.searchsorted(rows, rows)
            few = np.arange(len(rows)) - begins < (sizes - _least_overlap(sizes) + _needed(sizes))[rows]
            rows, grams = rows[few], grams[few]
            grams = mixed(grams)
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((rows, bucket))
            rows, grams, bucket = rows[order], grams[order], bucket[order]
            heads = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (bucket[1:] != bucket[:-1])]))
            found, firsts = np.unique(bucket, return_index=True)
            ends = np.append(firsts[1:], len(rows))
            doc_ends = np.searchsorted(heads, ends)
            # 48 bits of an n-gram's hash, besides the block's number
            columns = {
                "high": binaries((grams >> np.uint64(32)).astype(np.uint32), ends),
                "low": binaries(((grams >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16), ends),
                "docs": binaries(docs[rows[heads]], doc_ends),
                "sizes": binaries(sizes[rows[heads]].astype(np.int32), doc_ends),
                "per_doc": binaries(np.diff(np.append(heads, len(rows))).astype(np.uint32), doc_ends),
            }
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *columns.values()], names=["bucket", *columns])

    return entries


_ENTRIES = "bucket int, high binary, low binary, docs binary, sizes binary, per_doc binary"


def _ties(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs of documents of close set sizes that share n-grams of this block, how many (`n`), and how many a linked pair
    shares in all blocks (`needed`).

    A block makes about as many pairs as it has entries: documents of an n-gram that very many share are tied in
    order of set size instead, which counts as all that is needed.
    """
    grams = (joined(table.column("high"), np.uint32).astype(np.uint64) << np.uint64(16)) | joined(table.column("low"), np.uint16)
    per_doc = joined(table.column("per_doc"), np.uint32)
    docs, sizes = (np.repeat(joined(table.column(c), k).astype(np.int64), per_doc) for c, k in (("docs", np.int64), ("sizes", np.int32)))
    most = len(grams)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    order = order[np.lexsort((docs[order], sizes[order], grams[order]))]
    grams, docs, sizes = grams[order], docs[order], sizes[order]
    del ordered, same, shared, order, per_doc
    # runs of neighbours of one n-gram and close sizes, and the last row that is close to each row
    heads = np.ones(len(grams), bool)
    heads[1:] = (grams[1:] != grams[:-1]) | (100 * sizes[:-1] < PERCENT * sizes[1:])
    run = np.cumsum(heads) - 1
    reach = np.searchsorted(run << 32 | sizes, run << 32 | 100 * sizes // PERCENT, "right") - np.arange(len(grams)) - 1
    lengths, pairs = np.bincount(run), np.bincount(run, reach).astype(np.int64)
    narrow = pairs <= PAIRS * lengths
    by_width = np.argsort(np.where(narrow, pairs / np.maximum(lengths, 1), np.inf), kind="stable")
    narrow[by_width] &= np.cumsum(pairs[by_width]) <= most
    counted, chained = np.flatnonzero(narrow[run]), np.flatnonzero(~narrow[run] & (reach > 0))
    left = np.concatenate([np.repeat(counted, reach[counted]), chained])
    right = np.concatenate([spans(counted + 1, reach[counted]), chained + 1])
    n = np.ones(len(left), np.int64)
    n[len(left) - len(chained) :] = ENOUGH
    needed = _needed(sizes[left])
    names, place = np.unique(docs, return_inverse=True)
    left, right = place[left], place[right]
    pair = np.minimum(left, right) << 32 | np.maximum(left, right)
    order = np.argsort(pair, kind="stable")
    order = order[(left != right)[order]]
    pair = pair[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n, needed = (f.reduceat(x[order], first) if len(first) else x[:0] for f, x in ((np.add, n), (np.minimum, needed)))
    pair = pair[first]
    columns = {"a": names[pair >> 32], "b": names[pair & 0xFFFFFFFF], "n": np.minimum(n, ENOUGH).astype(np.int32), "needed": needed.astype(np.int32)}
    return pa.table(columns)


class _Tile:
    """Sets of one tile as sparse rows, with the running components of their links."""

    def __init__(self, docs: np.ndarray, values: np.ndarray, offsets: np.ndarray):
        self.sizes = np.diff(offsets)
        self.docs, self.values, self.offsets = docs, values, offsets
        self.label = np.arange(len(docs))
        found, self.column = np.unique(values, return_inverse=True)
        order = np.argsort(self.column, kind="stable")
        self.posting = np.repeat(np.arange(len(docs)), self.sizes)[order]
        self.starts = np.searchsorted(self.column[order], np.arange(len(found) + 1))

    def link_row(self, row: int, among: np.ndarray) -> None:
        """One row of the product: overlaps with all sets, of which those in `among` may still join."""
        columns = self.column[self.offsets[row] : self.offsets[row + 1]]
        begins = self.starts[columns]
        near = self.posting[spans(begins, self.starts[columns + 1] - begins)]
        overlap = np.bincount(near, minlength=len(self.docs))
        union = self.sizes[row] + self.sizes - overlap
        linked = among & (100 * overlap >= PERCENT * union) & (overlap > 0)
        if linked.any():
            old = np.unique(np.append(self.label[linked], self.label[row]))
            self.label[np.isin(self.label, old)] = old[0]

    def open_for(self, row: int, side: np.ndarray | None = None) -> np.ndarray:
        size = self.sizes[row]
        among = (self.label != self.label[row]) & (100 * self.sizes >= PERCENT * size) & (100 * size >= PERCENT * self.sizes)
        return among if side is None else among & side


def _linked(docs: np.ndarray, values: np.ndarray, offsets: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all linked sets of a tile: pairs of documents. With sides given, only products of a row
    of one side with one of the other are formed."""
    keys = _set_key(values, offsets)
    sizes = np.diff(offsets)
    _, first, member = np.unique(np.stack([keys, sizes.astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True)
    member = member.ravel()
    a, b = [docs[first[member]]], [docs]
    if left is not None:
        left, right = (np.bincount(member, x, len(first)) > 0 for x in (left, right))
    ends = np.cumsum(sizes[first])
    tile = _Tile(docs[first], values[spans(offsets[first], sizes[first])], np.concatenate([[0], ends]))
    for row in np.argsort(-tile.sizes, kind="stable"):
        if left is not None and not left[row]:
            continue
        among = tile.open_for(row, right)
        if among.any():
            tile.link_row(row, among)
    a.append(tile.docs[tile.label])
    b.append(tile.docs)
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def _filter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_filter_place(np.asarray(batch.column("node")))] = True
    parts = np.split(np.packbits(bits), FILTER_PARTS)
    used = [i for i, x in enumerate(parts) if x.any()]
    arrays = [pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())]
    yield pa.RecordBatch.from_arrays(arrays, names=["part", "bits"])


def _filter_place(docs: np.ndarray) -> np.ndarray:
    return (mixed(docs.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter_sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _candidate_sets(shared):
    """Sets of the documents that the filter lets through: all candidates, and few others."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            place = _filter_place(np.asarray(batch.column("doc_id")))
            chosen = batch.filter(pa.array((bits[place >> 3] >> (7 - (place & 7))) & 1 == 1))
            for piece in sliced([chosen], "text"):
                values, offsets = shingle_sets(piece.column("text"))
                arrays = [piece.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), binaries(values, offsets[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "entries", "grams"])

    return sets


def _multiply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links within each component of a group of whole components, or between two blocks of one component."""
    owner = np.asarray(table.column("component"))
    data, offsets = flat(table.column("grams"))
    values, offsets = data.view(np.uint64), offsets // 8
    docs = np.asarray(table.column("doc_id"))
    side = np.asarray(table.column("side"))
    order = np.lexsort((docs, owner))
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(owner[order]) != 0, [True]]))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        rows = order[i:j]
        sizes = offsets[rows + 1] - offsets[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        own = values[spans(offsets[rows], sizes)]
        sides = side[rows]
        if (sides == 0).all():
            found.append(_linked(docs[rows], own, ends))
        else:
            found.append(_linked(docs[rows], own, ends, sides == 1, sides == 2))
    a, b = map(np.concatenate, zip(*found, strict=True))
    return pa.table({"a": a, "b": b})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Class of every document under the links of at least PERCENT % Jaccard likeness of word n-gram sets.

    Returns doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included).
    Only A-Z are lower-cased; words are parted by ASCII white space. A missing or empty text, or one without
    words, has an empty set and no links. Rows with a missing doc_id are left out; rows that repeat a doc_id
    keep a row each, and share their class. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna(subset=["doc_id"])
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    # about one entry in five of a word each six bytes
    buckets = max(8, int(total / 30 // BLOCK_ENTRIES))
    shared = spark.sparkContext.broadcast(frequencies(rows))  # of fixed size
    entries = rows.mapInArrow(_prefix_entries(shared, buckets), _ENTRIES)
    ties = entries.groupBy("bucket").applyInArrow(grouped(_ties), "a long, b long, n int, needed int")
    # an id may stand on several texts: the least that one of them needs
    ties = ties.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("needed").alias("needed")).filter("n >= needed")
    sizes = written(rows.mapInArrow(_set_sizes, "doc_id long, n_shingles long, key long"), "sizes")
    # equal sets are linked to their smallest document, which stands for them from here on
    known = sizes.filter("n_shingles > 0")
    heads = known.groupBy("key", "n_shingles").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    copies = known.join(heads, ["key", "n_shingles"]).filter("doc_id <> a").select("a", "doc_id", "key", "n_shingles")
    copied = written(copies.distinct(), "copies")
    copies = copied.select("a", F.col("doc_id").alias("b"))
    # an id that stands on another text as well is no mere copy
    only = copied.select("doc_id").distinct()
    more = known.join(only, "doc_id", "left_semi").join(copied, ["doc_id", "key", "n_shingles"], "left_anti").select("doc_id")
    only = only.join(more, "doc_id", "left_anti").withColumnRenamed("doc_id", "node")
    # written once, as it is used twice
    candidates = written(connected(ties, "candidates").join(only, "node", "left_anti"), "candidates")
    # a component of copies of one set has nothing left to multiply
    several = candidates.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    candidates = candidates.join(several, "component").select(F.col("node").alias("doc_id"), "component")
    # what is multiplied where follows from the sizes alone, so that sets are shuffled with their place already known
    loads = known.groupBy("doc_id").agg(F.sum("n_shingles").alias("entries"))
    links = _links(rows, written(candidates.join(loads, "doc_id"), "candidates"))
    classes = connected(links.unionByName(copies), "links").withColumnRenamed("node", "doc_id")
    found = sizes.join(classes, "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _links(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links (a, b) that join all linked documents, found by multiplying out each candidate component.

    Sets of candidates are made where the texts are: a filter of fixed size tells which they can be, so that
    only their sets are shuffled. Should candidates ever fill the filter, all sets are.
    """
    spark = rows.sparkSession
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = len(bits) // FILTER_PARTS
    parts = candidates.select(F.col("doc_id").alias("node")).mapInArrow(_filter_parts, "part int, bits binary")
    for row in parts.groupBy("part").applyInArrow(grouped(_filter_sum), "part int, bits binary").toLocalIterator():
        bits[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    sets = rows.mapInArrow(_candidate_sets(spark.sparkContext.broadcast(bits)), "doc_id long, entries long, grams binary")
    loads = candidates.groupBy("component").agg(F.sum("entries").alias("load"))
    total = loads.agg(F.sum("load")).first()[0] or 0
    groups = max(1, int(total // TILE_ENTRIES))
    loads = loads.withColumn("blocks", F.ceil(F.col("load") / TILE_ENTRIES).cast("int"))
    # merge joins at any size: a broadcast that only small inputs get would say nothing about large ones
    placed = candidates.join(loads.hint("merge"), "component")
    whole = F.array(F.struct(F.lit(0).alias("side"), F.pmod(F.xxhash64("component"), F.lit(groups)).cast("string").alias("at")))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    # every pair of blocks is a tile; the lower block is one side, the higher the other
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.when(j == block, 0).when(block < j, 1).otherwise(2).alias("side"),
            F.concat_ws("-", F.lit("tile"), "component", F.least(j, block), F.greatest(j, block)).alias("at"),
        ),
    )
    places = placed.select("doc_id", "component", F.when(F.col("blocks") <= 1, whole).otherwise(tiles).alias("places"))
    found = sets.select("doc_id", "grams").join(places.hint("merge"), "doc_id")
    found = found.select("doc_id", "component", F.explode("places").alias("t"), "grams").select("doc_id", "component", "t.side", "t.at", "grams")
    return found.groupBy("at").applyInArrow(grouped(_multiply), "a long, b long")
