"""Cross-tokenizer alignment over distinct texts.

Texts are shuffled by their full text, so each distinct text is tokenised and aligned once, by a byte-level and a
sentence-piece tokenizer; counts of token pairs are weighted by the number of copies, and measures are joined back to
the documents. Two tokens whose byte ranges end together are linked. The shorter one's bytes are then an ending of the
longer one's, so the possible pairs follow from the two vocabularies alone: their number bounds all that is counted,
collected and broadcast, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsieve.llm.arrays import binaries, sliced, spans
from kinsieve.operators.joins import salted_join
from kinsieve.session import written

SLICE_BYTES = 1 << 20
# aligned words that a task keeps: so many, or of so many characters in all
KEPT_WORDS = 600_000
KEPT_CHARS = 16 << 20
WORDS_AT_ONCE = 500
# a text that stands on at least this share of all rows is joined with salts; there are at most 100 of them
HOT_SHARE = 0.01

_MEASURES = "key string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ALIGNED = f"{_MEASURES}, copies long, pairs binary, seen binary"
# a single space within a text: both tokenizers begin a token there
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the pairs that can end together."""

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        from kinsieve.llm.bpe import _byte_letters

        # Spark runs a worker per core already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=pieces)
        with open(byte_level, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = _byte_letters()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes_a[i] = bytes(letters[c] for c in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        # no piece holds a space behind another sign, so none reaches over a single space within a text
        self.apart = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        self.pairs = self._possible()
        spelt = lambda n: np.array([f"{i}{end}".encode() for i in range(n) for end in (",", "|", ";")], object)
        self.spelt = spelt(max(len(self.bytes_a), len(self.bytes_b)))

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _possible(self) -> np.ndarray:
        """Every pair of which one token's bytes end the other's, as b << 32 | a, ascending."""
        of_a: dict[bytes, list[int]] = {}
        of_b: dict[bytes, list[int]] = {}
        for found, tokens in ((of_a, self.bytes_a), (of_b, self.bytes_b)):
            for i, token in enumerate(tokens):
                if token:
                    found.setdefault(token, []).append(i)
        pairs = {(b, a) for a, token in enumerate(self.bytes_a) for i in range(len(token)) for b in of_b.get(token[i:], ())}
        pairs |= {(b, a) for b, token in enumerate(self.bytes_b) for i in range(len(token)) for a in of_a.get(token[i:], ())}
        return np.sort(np.array([b << 32 | a for b, a in pairs], np.int64))

    def words(self, text: str) -> list[str]:
        """The text cut at single spaces, where no token reaches across: a word with a space before it has the same tokens
        by itself. The space is the one that both tokenizers are given before a text."""
        if not text:
            return []
        return _SINGLE_SPACE.split(text) if self.apart else [text]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers, word after word, and how many each word has; none where the joined bytes of either
        differ from a space and the word."""
        found = self._together(words) if self.apart else None
        if found is None:
            found = self._one_by_one(words)
        return found

    def _together(self, words: list[str]):
        """Many words in one call; only if every word comes back."""
        some = [" ".join(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        found_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in some], add_special_tokens=False)]
        found_b = self.b.encode(some, num_threads=1)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        whole = (" " + " ".join(words)).encode()
        arrays, counts = [], []
        for lists, tokens, length in ((found_a, self.bytes_a, self.length_a), (found_b, self.bytes_b, self.length_b)):
            if b"".join(map(tokens.__getitem__, chain(*lists))) != whole:
                return None
            ids = np.fromiter(chain(*lists), np.int64, sum(map(len, lists)))
            token_ends = np.cumsum(length[ids])
            behind = np.searchsorted(token_ends, ends, "right")
            if (token_ends[behind - 1] != ends).any():
                return None
            arrays.append(ids)
            counts.append(np.diff(behind, prepend=0))
        return (*arrays, *counts)

    def _one_by_one(self, words: list[str]):
        found_a = [e.ids for e in self.a.encode_batch([" " + w for w in words], add_special_tokens=False)]
        found_b = self.b.encode(words, num_threads=1)
        for i, word in enumerate(words):
            spelt_a, spelt_b = b"".join([self.bytes_a[x] for x in found_a[i]]), b"".join([self.bytes_b[x] for x in found_b[i]])
            if not spelt_a == spelt_b == (" " + word).encode():
                found_a[i] = found_b[i] = []
        counts = [np.array([len(x) for x in lists], np.int64) for lists in (found_a, found_b)]
        arrays = [np.fromiter(chain(*lists), np.int64, int(n.sum())) for lists, n in zip((found_a, found_b), counts, strict=True)]
        return (*arrays, *counts)

    def align(self, words: list[str]):
        """Per word: tokens of A, tokens of B, groups and the groups written out; and the pair numbers of all links."""
        a, b, n_a, n_b = self.encode(words)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        size = int(ends_a[-1]) if len(a) else 0
        at_a, at_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        # a word ends with both, so groups never cross words
        cut_a, cut_b = at_b[ends_a], at_a[ends_b]
        links = np.searchsorted(self.pairs, b[cut_b] << 32 | a[cut_a]).astype(np.int32)
        word_a = np.repeat(np.arange(len(words)), n_a)
        n_groups = np.bincount(word_a[cut_a], minlength=len(words)).astype(np.int64)

        # groups in a row: the tokens of A, then those of B
        group_a, group_b = (np.cumsum(cut) - cut for cut in (cut_a, cut_b))
        behind_a = np.concatenate([[0], np.flatnonzero(cut_a) + 1])
        behind_b = np.concatenate([[0], np.flatnonzero(cut_b) + 1])
        place_a = np.arange(len(a)) + behind_b[group_a]
        place_b = np.arange(len(b)) + behind_a[group_b + 1]
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a], codes[place_b] = 3 * a + cut_a, 3 * b + 2 * cut_b
        spelt = self.spelt[codes].tolist()
        ends = np.cumsum(n_a + n_b)
        groups = [b"".join(spelt[e - n : e])[:-1] for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]
        return n_a, n_b, n_groups, groups, links


class AlignedWords:
    """Words with their alignment, each computed when it first comes up. A text's alignment is that of its words in a row."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[bytes] = []
        self.n_a = self.n_b = self.n_groups = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        fresh = sorted(set(words).difference(self.number))
        if not fresh:
            return
        n_a, n_b, n_groups, groups, links = self.both.align(fresh)
        self.number |= {w: i for i, w in enumerate(fresh, start=len(self.number))}
        self.chars += sum(map(len, fresh))
        self.groups += groups
        self.n_a, self.n_b = np.append(self.n_a, n_a), np.append(self.n_b, n_b)
        self.n_groups, self.links = np.append(self.n_groups, n_groups), np.append(self.links, links)

    def align(self, texts: list[str]):
        """As `Tokenizers.align`, for whole texts; a text with a word that does not come back has nothing."""
        if len(self.number) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.forget()
        cut = [self.both.words(t) for t in texts]
        words = [w for part in cut for w in part]
        self.learn(words)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        n_words = np.array([len(part) for part in cut], np.int64)
        ends = np.cumsum(n_words)

        def summed(values: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(values)])
            return upto[ends] - upto[ends - n_words]

        fine = summed(self.n_a[numbers] == 0) == 0
        kept = numbers[np.repeat(fine, n_words)]
        begins = np.cumsum(self.n_groups) - self.n_groups
        links = self.links[spans(begins[kept], self.n_groups[kept])]
        groups = [
            b";".join([self.groups[i] for i in numbers[e - n : e].tolist()]) if ok else b""
            for e, n, ok in zip(ends.tolist(), n_words.tolist(), fine.tolist(), strict=True)
        ]
        n_a, n_b, n_groups = (np.where(fine, summed(x[numbers]), 0) for x in (self.n_a, self.n_b, self.n_groups))
        return n_a, n_b, n_groups, groups, links


@lru_cache(maxsize=1)
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """Read once per Python worker; both files lie at the same paths on every node."""
    return Tokenizers(byte_level, pieces)


@lru_cache(maxsize=1)
def aligned_words(byte_level: str, pieces: str) -> AlignedWords:
    """Kept over the tasks of a Python worker; what a text gets does not depend on what is known already."""
    return AlignedWords(tokenizers(byte_level, pieces))


def _align(byte_level: str, pieces: str):
    """A row per distinct text with its links; then one row per task with how often each pair was seen."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligned_words(byte_level, pieces)
        seen = np.zeros(len(known.both.pairs), np.int64)
        names = [part.split(" ")[0] for part in _ALIGNED.split(", ")]
        for batch in sliced(batches, "text", SLICE_BYTES):
            n_a, n_b, n_groups, groups, links = known.align(batch.column("text").to_pylist())
            copies = np.asarray(batch.column("copies"))
            # whole numbers below 2**53 are exact as weights
            seen += np.bincount(links, np.repeat(copies, n_groups), len(seen)).astype(np.int64)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            columns = [batch.column("key"), n_a, n_b, n_groups, n_groups, digests, copies]
            columns = [pa.array(c) for c in columns] + [binaries(links, np.cumsum(n_groups)), pa.nulls(len(groups), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        found = np.flatnonzero(seen)
        packed = np.stack([found, seen[found]], axis=1).astype("<i8").tobytes()
        kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.array([packed], pa.binary())], names=names)

    return align


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("seen").to_pylist():
            items = np.frombuffer(packed, "<i8").reshape(-1, 2)
            yield pa.record_batch([pa.array(items[:, 0]), pa.array(items[:, 1])], ["pair", "n"])


def _measure(counts, best):
    """Adds the sum of the pair counts over a text's links, and how many links are the best of their B token."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in _MEASURES.split(", ")]
        for batch in batches:
            sums, tops = [], []
            for packed in batch.column("pairs").to_pylist():
                links = np.frombuffer(packed, "<i4")
                sums.append(int(counts.value[links].sum()))
                tops.append(int(best.value[links].sum()))
            columns = [batch.column(n) for n in names] + [pa.array(tops, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_best", "count_sum"])

    return measure


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text") -> DataFrame:
    """Add how the tokens of two tokenizers lie against each other in each row's text: n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    `byte_level` encodes a space and the text, `pieces` the text (to which it adds the space itself); both are paths that
    hold on all nodes, special tokens' strings are plain text. Byte offsets where tokens of both end cut the text into
    groups; the two tokens that end there are linked. A pair's count is the number of links over all rows, copies and
    repeated rows included. n_best counts the links whose pair is the most frequent one of its B token (ties too), count_sum adds the
    pair counts of the links; groups_sha256 digests the groups' ids, written `a1,a2|b1;a3|b2,b3`.

    A missing or empty text, or one that either tokenizer does not give back byte by byte, has zeros and an empty digest. Equal
    texts get equal measures. An empty table gives no rows. Extra columns are kept; one that is called like an
    output column is replaced. Texts are cut at single spaces, which no token crosses, and each word is encoded and aligned
    when a task first meets it; a very long text is thus handled word by word.
    """
    spark = docs.sparkSession
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    kept = docs.drop(*names)
    text_of = F.coalesce(F.col(text), F.lit(""))
    distinct = docs.select(text_of.alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    distinct = distinct.withColumn("key", F.sha2("text", 256))
    aligned = written(distinct.mapInArrow(_align(byte_level, pieces), _ALIGNED), "aligned")

    pairs = tokenizers(byte_level, pieces).pairs
    seen = aligned.filter(F.col("seen").isNotNull()).select("seen").mapInArrow(_unpack, "pair long, n long")
    # at most one row per possible pair of the two vocabularies
    totals = seen.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(pairs), np.int64)
    counts[np.asarray(totals.column("pair"))] = np.asarray(totals.column("n"))
    first = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
    highest = np.maximum.reduceat(counts, first)
    best = counts == np.repeat(highest, np.diff(np.append(first, len(pairs))))

    texts = aligned.filter(F.col("seen").isNull())
    columns = f"{_MEASURES}, n_best long, count_sum long"
    measures = texts.mapInArrow(_measure(spark.sparkContext.broadcast(counts), spark.sparkContext.broadcast(best)), columns)
    rows = texts.agg(F.sum("copies")).first()[0] or 0
    hot = texts.filter((F.col("copies") > 1) & (F.col("copies") >= HOT_SHARE * rows)).select("key").collect()
    keyed = kept.withColumn("__text_key", F.sha2(text_of, 256))
    measures = measures.withColumnRenamed("key", "__text_key")
    joined = salted_join(keyed, measures, ["__text_key"], "left", hot=[row["key"] for row in hot])
    return joined.select(*kept.columns, *names)
