"""Small helpers between Arrow columns and numpy, used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
# words are hashed in pieces, as that takes some 45 bytes per byte of text in a worker per core
PIECE_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = values + _GOLDEN
    values ^= values >> np.uint64(30)
    values *= _MIX1
    values ^= values >> np.uint64(27)
    values *= _MIX2
    values ^= values >> np.uint64(31)
    return values


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the offsets of its rows; a missing value is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batches, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about `most` bytes of text: working arrays are several
    times the text, and rows differ in length by orders of magnitude. One longer row is a piece by itself."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = flat(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            give_back()
            begin = end
        del batch


def give_back() -> None:
    """Return freed memory to the system: workers stay for later stages, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def grouped(function):
    """A function of a group whose memory is returned before the next group comes."""

    def call(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return function(key, table)
        finally:
            give_back()

    return call


def cogrouped(function):
    """As `grouped`, for two sides."""

    def call(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(key, left, right)
        finally:
            give_back()

    return call


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of `data` that end at `ends` (in items)."""
    data = np.ascontiguousarray(data)
    offsets = np.concatenate([[0], ends]).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def bucketed(bucket: np.ndarray, columns: dict[str, np.ndarray], name: str = "bucket") -> pa.RecordBatch:
    """One row per bucket that holds the bucket's items of each column as packed bytes, in given order.
    Few large rows cost Spark far less to shuffle than one row per item."""
    order = np.argsort(bucket, kind="stable")
    found, counts = np.unique(bucket, return_counts=True)
    ends = np.cumsum(counts)
    arrays = {name: pa.array(found.astype(np.int32)), "n": pa.array(counts.astype(np.int64))}
    arrays |= {k: binaries(v[order], ends) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All items of a column of packed bytes."""
    return flat(column)[0].view(kind)


_WORD_BASE = np.uint64(0x5851F42D4C957F2D)


def pieces(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The rows in pieces of about `most` bytes, cut between words: bytes, offsets within the piece, number of its first row."""
    begin = 0
    while begin < len(data):
        end = begin + most
        while end < len(data):
            gaps = np.flatnonzero(gap[data[end : end + 4096]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += 4096
        end = min(end, len(data))
        first, last = np.searchsorted(offsets, begin, "right") - 1, np.searchsorted(offsets, end, "left")
        yield data[begin:end], np.clip(offsets[first : last + 1], begin, end) - begin, int(first)
        begin = end


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, code: np.ndarray, gap: np.ndarray, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the rows, in text order, and those of its prefixes of the given lengths in bytes, where
    the word is longer (behind the words of each piece)."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for part, ends, first in pieces(data, offsets, gap, PIECE_BYTES):
        hashes, rows = _piece_hashes(part, ends, code, gap, prefixes)
        found.append((hashes, rows + first))
    hashes, rows = zip(*found, strict=True)
    return np.concatenate(hashes), np.concatenate(rows)


def _piece_hashes(
    data: np.ndarray, offsets: np.ndarray, code: np.ndarray, gap: np.ndarray, prefixes: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray]:
    """The words of one piece, then their prefixes.

    `code` maps each byte to its value in the hash (lower-casing), `gap` tells which bytes part words. A word's
    hash is a difference of two running sums, brought to the word's own start by an inverse power.
    """
    size = len(data)
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~gap[data]
    first = np.zeros(size, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begin)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = np.ones(size, bool)
    stop[:-1] = ~inside[1:] | first[1:]
    ends = np.flatnonzero(stop & inside) + 1
    power = np.full(size, _WORD_BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(code[data] * power, out=sums[1:])
    back = np.full(size, pow(int(_WORD_BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    rows = np.searchsorted(offsets, starts, "right") - 1
    lengths = ends - starts
    found = [(mixed((sums[ends] - sums[starts]) * back[starts] ^ lengths.astype(np.uint64)), rows)]
    for length in prefixes:
        longer = starts[lengths > length]
        values = (sums[longer + length] - sums[longer]) * back[longer]
        found.append((mixed(values ^ np.uint64(length << 32)), rows[lengths > length]))
    hashes, rows = zip(*found, strict=True)
    return np.concatenate(hashes), np.concatenate(rows)
