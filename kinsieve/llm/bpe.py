"""Byte-level BPE: encoding by prefix-sharing trie traversal, and decoding.

The encoding of a prefix of a word is the encoding of a shorter prefix plus one token, so a prefix is fully
described by its last token. Distinct words are put in a trie (kept as the sorted list of words, whose
depth-first order it is); the walk keeps the last token of every prefix on the path and computes each shared
prefix once. A token may end a prefix if it stands there in full and if no merge would have crossed its left
border; exactly one does.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinsieve.llm.arrays import sliced

# an executor runs an encoder and a decoder per core, so working sets are kept small
SLICE_BYTES = 1 << 20
KEPT_WORDS = 150_000
KEPT_PAIRS = 500_000

SPACE, LETTER, DIGIT, OTHER = range(4)
# fixed values: endings that are words of their own after an apostrophe
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """White space, letter, digit or other for each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first in "LN":
            kinds[code] = LETTER if first == "L" else DIGIT
        elif first == "Z" or code in (*range(9, 14), 0x85):
            kinds[code] = SPACE
    return kinds


def word_starts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the words of the concatenated texts start; `begins` are the starts of the (non-empty) texts.

    A word is a run of letters, digits or other signs, with the space before it if there is one; white space
    that no word takes is a word of its own, and so is a contraction's ending.
    """
    kinds = _kinds()[codes]
    size = len(codes)
    edge = np.zeros(size + 3, bool)
    edge[begins] = True
    edge[size:] = True
    start = edge.copy()
    start[1:size] |= kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(start[: size + 1])
    run_end = runs[1:]
    gaps = run_end[(kinds[runs[:-1]] == SPACE) & ~edge[run_end]]  # first sign after white space
    start[gaps - 1] = True
    start[gaps[codes[gaps - 1] == 32]] = False
    lone = np.flatnonzero((codes == 39) & start[:size])
    lone = lone[~edge[lone + 1] & start[lone + 1]]
    after = np.concatenate([codes, np.zeros(3, codes.dtype)])
    short = lone[np.isin(after[lone + 1], [ord(c) for c in SHORT_ENDINGS])]
    long = [lone[(after[lone + 1] == ord(x)) & (after[lone + 2] == ord(y)) & ~edge[lone + 2]] for x, y in LONG_ENDINGS]
    for places, length in ((short, 2), (np.concatenate(long), 3)):
        start[places + 1] = False
        start[places + length] = True
    return np.flatnonzero(start[:size])


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and special tokens of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.tokens = {i: token for token, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            a, b = self.ids[left], self.ids[right]
            self.rank[a, b] = rank
            self.parts.setdefault(self.ids[left + right], (rank, a, b))
        # every ending of a token, with its id if it is a token itself
        self.tails = {token[i:]: self.ids.get(token[i:], -1) for token in self.ids for i in range(len(token))}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._stands: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that occur along one edge of a token while it is put together, each with the rank of the
        merge that consumes it."""
        found = self._edges.get((token, side))
        if found is None:
            found, part, until = [], token, float("inf")
            while True:
                found.append((part, until))
                if part not in self.parts:
                    break
                until, part = self.parts[part][0], self.parts[part][side]
            self._edges[token, side] = found
        return found

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether the two tokens, each complete, stay apart: ranks grow as a word is merged, so a merge over
        the border happens if its rank comes before those that consume its two parts (or ties with the right
        one, as the leftmost of equal merges goes first)."""
        for a, until_a in self._edge(left, 2):
            for b, until_b in self._edge(right, 1):
                rank = self.rank.get((a, b))
                if rank is not None and rank < until_a and rank <= until_b:
                    return False
        return True

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its tokens, in one depth-first walk over the trie of the words."""
        tail_of, size = self.tails.get, len(self.tokens) + 1
        stands = self._stands
        if len(stands) > KEPT_PAIRS:
            stands.clear()
        last, since = [-1], [0]  # last token of every prefix on the current path, and where it begins
        path = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], since[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # most often the last token of the prefix before grows by one byte: look there first
                begin = since[-1]
                token = tail_of(word[begin:end], -1)
                if token < 0 or begin and not stands.get(last[begin] * size + token):
                    begin = end - 1
                    while True:
                        token = tail_of(word[begin:end]) if begin >= 0 else None
                        if token is None:
                            raise ValueError(f"no tokens for {word[:end]!r}")
                        if token >= 0:
                            if begin == 0:
                                break
                            pair = last[begin] * size + token
                            apart = stands.get(pair)
                            if apart is None:
                                apart = stands[pair] = self.side_by_side(last[begin], token)
                            if apart:
                                break
                        begin -= 1
                last.append(token)
                since.append(begin)
            path = word
            found, end = [], len(word)
            while end:
                found.append(last[end])
                end = since[end]
            found.reverse()
            yield word, found

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The words of each text; special tokens are words of their own."""
        parts, owner, special = [], [], {}
        for i, text in enumerate(texts):
            cut = self.cuts.split(text) if self.cuts and self.cuts.search(text) else [text]
            for part in cut:
                if part:
                    if len(cut) > 1 and part in self.special:
                        special[len(parts)] = part
                    parts.append(part)
                    owner.append(i)
        found: list[list[str]] = [[] for _ in texts]
        if not parts:
            return found
        whole = "".join(parts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        starts = word_starts(codes, begins)
        first = np.searchsorted(starts, begins).tolist() + [len(starts)]
        starts = [*starts.tolist(), len(whole)]
        words = [whole[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        for i, text in enumerate(owner):
            found[text] += [special[i]] if i in special else words[first[i] : first[i + 1]]
        return found


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """Just the tokens, which is all that decoding needs."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_letters()
    tokens = {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    return tokens | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once per Python worker; the file lies at the same path on every node."""
    return Vocabulary(path)


def _encoder(path: str, text: str, name: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        known: dict[str, bytes] = {}
        fixed = {s: np.array([i], "<u4").tobytes() for s, i in vocab.special.items()}
        for batch in sliced(batches, text, SLICE_BYTES):
            pieces = vocab.pieces([t or "" for t in batch.column(text).to_pylist()])
            if len(known) > KEPT_WORDS:
                known = {}
            fresh = set().union(*pieces).difference(known, fixed)
            for word, found in vocab.encode_words([w.encode() for w in fresh]):
                known[word.decode()] = np.array(found, "<u4").tobytes()
            known |= fixed
            ids = [b"".join(map(known.__getitem__, words)) for words in pieces]
            columns = {c: batch.column(c) for c in batch.schema.names} | {name: pa.array(ids, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return encode


def _decoder(path: str, ids: str, name: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in sliced(batches, ids, SLICE_BYTES):
            texts = [
                b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
                for x in batch.column(ids).to_pylist()
            ]
            columns = {c: batch.column(c) for c in batch.schema.names} | {name: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return decode


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of every whole text as packed little-endian unsigned 32-bit integers.

    `tokenizer` is the path of a byte-level tokenizer file, the same on all nodes. A missing or empty text
    gives empty bytes. Special tokens written out in a text become their own id. An input column called like
    the output is replaced. No shuffle: each task walks the trie of the distinct words of some MB of text.
    """
    rest = df.drop(ids)
    return rest.mapInArrow(_encoder(tokenizer, text, ids), rest.withColumn(ids, F.lit(b"")).schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of packed token ids; bytes that are not UTF-8 become replacement characters, and missing
    ids give an empty text. An input column called like the output is replaced; an unknown id fails."""
    rest = df.drop(text)
    return rest.mapInArrow(_decoder(tokenizer, ids, text), rest.withColumn(text, F.lit("")).schema)


def encode_and_decode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The results of `encode` and `decode` in place of the text. Both run in the same Python worker: as steps of their own they
    take two workers a core, and each keeps its vocabulary for as long as the executor is busy."""
    rest = df.drop(ids, decoded)
    names = [c for c in rest.columns if c != text]
    encoding, decoding = _encoder(tokenizer, text, ids), _decoder(tokenizer, ids, decoded)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoding(batch.select([*names, ids]) for batch in encoding(batches))

    return rest.mapInArrow(both, rest.select(*names).withColumn(ids, F.lit(b"")).withColumn(decoded, F.lit("")).schema)
