"""Suffix dedup, Jaccard join, components and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinsieve.llm import components, fingerprints, jaccard, suffixes


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def edited(rng, text, changes):
    parts = text.split(" ")
    for _ in range(changes):
        parts[rng.randrange(len(parts))] = f"z{rng.randint(0, 10**6)}"
    return " ".join(parts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    passage = words(rng, 60)
    base = [words(rng, rng.randint(1, 150)) for _ in range(40)]
    rows = base + [t for t in base[:10]] + [edited(rng, base[20], 1 + i % 4) for i in range(30)]
    rows += [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(25)] + [passage] * 3
    rows += ["", None, "one", "One", "one  two", "a" * 300, "ab" * 200, "ÄÖ ü " * 40, " \t\n", "A B C D E F", "a b c d e f"]
    rows += [words(rng, 20_000, 5)]
    rng.shuffle(rows)
    return rows


def removed(rows, width):
    first, out = {}, {}
    ordered = sorted(((2**63 - 2 if i is None else i), (t or "").encode()) for i, t in rows)
    for i, t in ordered:
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], i)
    for i, t in ordered:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < i:
                gone[p : p + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.setdefault(i, []).append((len(t), int(gone.sum()), runs, kept))
    return sorted((i, x) for i, v in out.items() for x in v)


@pytest.mark.parametrize("width,block,part", [(50, 12 << 20, 2 << 20), (20, 2_000, 2 << 20), (50, 12 << 20, 500), (12, 2_000, 100)])
def test_suffix_dedup_equals_brute_force(spark, texts, monkeypatch, width, block, part):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixes, "PART_BYTES", part)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    # repeated rows, a repeated id with another text, missing ids
    rows += [rows[4], (rows[5][0], texts[30]), (None, texts[2]), (None, texts[3])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_bytes string")
    got = suffixes.remove_repeats(df, width).collect()
    found = sorted((2**63 - 2 if r.doc_id is None else r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got)
    assert found == removed(rows, width)


@pytest.mark.parametrize("sample", [0, 16 << 20])
def test_suffix_dedup_spreads_the_strings_of_one_anchor(spark, monkeypatch, sample):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(suffixes, "SAMPLE_BYTES", sample)
    rng = random.Random(5)
    phrase = "the same sixteen and some bytes"
    rows = [(i, f"{rng.getrandbits(160):040x}{phrase}{rng.getrandbits(160):040x}") for i in range(600)]
    rows += [(i + 600, rows[i][1][8:] + "x") for i in range(0, 600, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeats(df).collect()
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == removed(rows, 50)
    texts = df.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("mark"))
    blocks = 23
    by_text = texts.withColumn("text_block", F.pmod("mark", F.lit(blocks)).cast("int")).groupBy("text_block")
    hot = suffixes.hot_anchors(texts, 90_000, 50, blocks)
    assert (len(hot) > 0) == (sample > 0)
    passages = suffixes._passages(texts, by_text, 50, blocks, hot)
    sizes = [r.n for r in passages.groupBy("block").agg(F.sum(F.length("passages")).alias("n")).collect()]
    assert max(sizes) < 4 * sum(sizes) / blocks


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_anchors_in_pieces_are_those_of_the_whole(piece):
    rng = np.random.default_rng(7)
    lengths = np.array([0, 3, 49, 50, 0, 51, 400, 0, 1300, 20])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = rng.integers(97, 99, offsets[-1]).astype(np.uint8)

    def strings(runs):
        return {(r, s + i, h) for r, s, n, h in zip(*(x.tolist() for x in runs), strict=True) for i in range(n)}

    whole = strings(suffixes.anchors(data, offsets, 50, len(data)))
    assert len(whole) == (lengths - 49).clip(0).sum()
    assert strings(suffixes.anchors(data, offsets, 50, piece)) == whole


def test_string_hashes_in_pieces(monkeypatch):
    data = np.frombuffer(b"abcabcabc" * 30, np.uint8)
    at = np.array([200, 0, 3, 1, 64, 67])
    whole = suffixes.string_hashes(data, at, 50)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 10)
    assert (suffixes.string_hashes(data, at, 50) == whole).all()
    # every third string is the same
    assert whole[1] == whole[2] and whole[3] == whole[4] == whole[5] != whole[1]


@pytest.mark.parametrize("width", [12, 20, 50])
def test_least_grams_in_pieces(monkeypatch, width):
    rng = np.random.default_rng(11)
    lengths = rng.integers(width, width + 35, 40)
    ends = np.cumsum(lengths)
    raw = rng.integers(97, 123, ends[-1]).astype(np.uint8)
    gram = min(suffixes.ANCHOR, width)
    one = lambda p: suffixes.mixed(suffixes._rolled(p, gram)).min()
    want = [one(raw[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
    for most in (1, 200, 1 << 20):
        monkeypatch.setattr(suffixes, "PIECE_BYTES", most)
        assert suffixes._least_grams(raw, ends, lengths, width).tolist() == want


def test_occurrences_some_at_a_time(monkeypatch):
    passages = [b"a" * 30 + b"b" * 25, b"b" * 25 + b"c" * 30, b"a" * 30 + b"b" * 25, b"a" * 5 + b"b" * 25 + b"c" * 30]
    raw, sizes = np.frombuffer(b"".join(passages), np.uint8), np.array([len(p) for p in passages])
    passage, docs, starts = np.array([0, 1, 2, 3, 0, 1]), np.array([5, 4, 3, 9, 3, 8]), np.array([0, 7, 7, 2, 50, 1])
    every = [x.tolist() for x in suffixes._lost(raw, np.cumsum(sizes), sizes, passage, docs, starts, 50)]
    # the copy in document 3 stays, as do both of its own; 9 and 8 share with 4
    assert every == [[0, 3, 5], [0, 7, 1], [6, 6, 6]]
    monkeypatch.setattr(suffixes, "OCCURRENCES", 2)
    assert [x.tolist() for x in suffixes._lost(raw, np.cumsum(sizes), sizes, passage, docs, starts, 50)] == every


def test_interval_starts_on_a_random_text():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 3_000).astype(np.uint16), 0).astype(np.uint16)
    text[1_000:1_400] = text[:400]
    order = suffixes.suffix_order(text, 50)
    cut = suffixes.interval_starts(text, order, 50)
    raw = text.tobytes()
    piece = lambda i: raw[2 * i : 2 * i + 100]
    want = [True] + [piece(order[k]) != piece(order[k - 1]) for k in range(1, len(order))]
    assert cut.tolist() == want


def classes(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


@pytest.mark.parametrize("tile", [300, 2 << 20])
def test_jaccard_equals_brute_force(spark, texts, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_ENTRIES", tile)
    rows = [(2 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1) for i, t in [*rows, (None, texts[0])]], "doc_id long, text string, component int")
    got = jaccard.near_duplicates(df)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == classes(rows)


def test_jaccard_edges(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(twice).collect())) == [(4, 2, 4), (5, 2, 4), (5, 2, 4)]

    x, z = "a b c d e f g h", " ".join(f"z{i}" for i in range(60))
    rows = spark.createDataFrame([(2, x), (5, x), (5, z), (9, z + " end")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(rows).collect())) == [(2, 4, 2), (5, 4, 2), (5, 56, 2), (9, 57, 2)]


class _Shared:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("most", [16, 1, 0])
def test_linked_sets_share_the_needed_ngrams(monkeypatch, most):
    monkeypatch.setattr(jaccard, "PAIRS", most)
    rng = random.Random(5)
    base = [words(rng, rng.choice([1, 4, 5, 6, 9, 30, 150, 700]), 12) for _ in range(60)] + [words(rng, 150, 12)]
    copies = [edited(rng, t, 1 + i % 8) for i, t in enumerate(base)] + [edited(rng, base[-1], 1 + i % 2) for i in range(40)]
    rows = list(enumerate(base + [t + " end" for t in base] + copies))
    table = np.asarray(np.random.default_rng(2).integers(0, 9, 1 << jaccard.TABLE_BITS), np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    counts = {}
    for block in pa.Table.from_batches(jaccard._prefix_entries(_Shared(table), 3)([batch])).to_batches():
        for i in range(block.num_rows):
            for x in jaccard._ties((block["bucket"][i],), pa.Table.from_batches([block.slice(i, 1)])).to_pylist():
                n, needed = counts.get((x["a"], x["b"]), (0, 1 << 30))
                counts[x["a"], x["b"]] = n + x["n"], min(needed, x["needed"])
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for (a, b), (n, needed) in counts.items():
        if n >= needed:
            root[find(b)] = find(a)
    sets = [set(jaccard.shingle_sets(pa.array([t]))[0].tolist()) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(linked) > 500
    assert all(find(a) == find(b) for a, b in linked)


@pytest.fixture
def candidate_ids(monkeypatch):
    """The ids of all candidates that are multiplied out."""
    seen, links = [], jaccard._links

    def kept(rows, candidates):
        seen.extend(r["doc_id"] for r in candidates.select("doc_id").collect())
        return links(rows, candidates)

    monkeypatch.setattr(jaccard, "_links", kept)
    return seen


def chained_texts():
    """Texts that share one rare n-gram each with the next one, and two near copies (100, 101)."""
    rng = random.Random(9)
    shared = [" ".join(f"s{i}x{k}" for k in range(5)) for i in range(81)]
    own = [words(rng, 60, 10**9) for _ in range(80)]
    rows = [(i, f"{shared[i]} {t} {shared[i + 1]}") for i, t in enumerate(own)]
    # longer texts make all other n-grams more frequent
    rows += [(200 + 3 * i + k, f"{t} {words(rng, 200, 10**9)}") for i, t in enumerate(own) for k in range(3)]
    near = words(rng, 200, 10**9)
    return [*rows, (100, near), (101, edited(rng, near, 2))]


def test_one_shared_ngram_makes_no_candidates(spark, candidate_ids):
    rows = chained_texts()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == classes(rows)
    assert sorted(candidate_ids) == [100, 101]


def test_pipeline_stage_has_no_candidates_by_one_ngram(spark, candidate_ids):
    from corpus_pipeline import keep_one_of_near_copies

    rows = chained_texts()
    got = keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in rows if r[0] != 101)
    assert sorted(candidate_ids) == [100, 101]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(300, 300), (None, 1)]
    edges += [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in (e for e in edges if None not in e):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if x != 300}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_steps_have_small_plans(spark, monkeypatch):
    plans, write = [], components.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(components, "written", seen)
    edges = [(i, i + 1) for i in range(30)]
    got = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(31)]
    # edges are read for their least neighbours and for the join with them, no more often
    assert max(p.count("Relation ") for p in plans) == 2


def test_fingerprints(spark, texts):
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in fingerprints.compare_with_next(df).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        want = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        row = got[i]
        assert (row.n_chars, row.edited) == (len(t), want)
        assert by_text.setdefault(t, row.fingerprint) == row.fingerprint
        assert row.edited_fingerprint == fingerprints.written(fingerprints.signature(want))
        assert row.near_next == fingerprints.agreement(fingerprints.signature(t), fingerprints.signature(after))
        assert 0 <= row.near_edited <= 1
    both = fingerprints.fingerprint(df).crossJoin(spark.createDataFrame([(got[0].fingerprint,)], "other string"))
    near = both.select("doc_id", fingerprints.likeness("fingerprint", "other").alias("near")).collect()
    for r in near:
        want = fingerprints.agreement(fingerprints.signature(dict(rows)[r.doc_id] or ""), fingerprints.signature(rows[0][1] or ""))
        assert r.near == pytest.approx(want)


def test_fingerprints_follow_order_and_edits():
    rng = random.Random(8)
    text = words(rng, 3_000, 10_000)
    half = len(text) // 2
    near = fingerprints.signature(edited(rng, text, 30))
    own, swapped = fingerprints.signature(text), fingerprints.signature(text[half:] + " " + text[:half])
    far = fingerprints.signature(words(rng, 3_000, 10_000))
    assert fingerprints.agreement(own, near) > 0.6
    # the same k-mers in another order are less alike
    assert fingerprints.agreement(own, far) < 0.3 < fingerprints.agreement(own, swapped) < 0.85


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(None, "abc"), (1, None), (1, "x"), (1, "x")], "doc_id long, text string")
    got = fingerprints.compare_with_next(df)
    assert sorted((r.doc_id is not None, r.n_chars) for r in got.collect()) == [(False, 3), (True, 0), (True, 1), (True, 1)]
    one = fingerprints.compare_with_next(df.limit(1)).collect()[0]
    assert one.near_next == 1.0
    assert fingerprints.compare_with_next(df.limit(0)).count() == 0
    assert hashlib.sha256(one.edited.encode()).hexdigest()


def test_words_hashed_in_pieces(monkeypatch):
    import pyarrow as pa

    from kinsieve.llm import arrays

    texts = ["", None, " ".join(f"word{i % 37}" for i in range(900)), "", "x" * 700, "a b", " ", "one two three four five six " * 30]
    whole = jaccard.shingle_sets(pa.array(texts))
    for size in (1, 50, 333):
        monkeypatch.setattr(arrays, "PIECE_BYTES", size)
        for x, y in zip(whole, jaccard.shingle_sets(pa.array(texts)), strict=True):
            assert x.tolist() == y.tolist()
