"""Centroid clustering, licence scans and cross-tokenizer alignment against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.llm import alignment, centroids, licences
from kinsieve.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


# -- clustering -----------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10, width=64):
    """The rounds in Python integers: {(id, vector): (cluster, distance)}, inertia, centroids."""

    def whole(x):
        return int(x) * 1024 if abs(x) >= 2.0**53 else math.floor(1024 * x)

    fine = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [whole(x) for x in v]) for i, v in fine]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    means = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        means = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(means)]
    return [(i, nearest(v)) for i, v in kept], means


def found_clusters(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    return centroids.cluster(frame, **options)


def compare_clusters(spark, rows, **options):
    expected, means = plain_clusters(rows, **options)
    limit = (1 << 63) - 1
    got = found_clusters(spark, rows, **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(
        ((i, c, min(d, limit)) for i, (d, c) in expected), key=key
    )
    sums = Counter()
    for _, (d, c) in expected:
        sums[c] += min(d, limit)
    for r in got:
        assert r.cluster_inertia == min(limit, sums[r.cluster]) and r.inertia == min(limit, sum(sums.values()))
        assert r.centroid == ",".join(map(str, means[r.cluster]))


def test_transform_keeps_distances_and_is_undone():
    random = np.random.default_rng(1)
    rows = random.integers(-1000, 1000, (20, 64))
    turned = centroids.transform(rows)
    assert (centroids.restore(turned) == rows).all()
    apart, apart_turned = rows[:, None] - rows[None], turned[:, None] - turned[None]
    assert ((apart_turned**2).sum(-1) == 64 * (apart**2).sum(-1)).all()
    # the first coefficients are the coarse ones: the sum, then the halves
    assert (turned[:, 0] == rows.sum(1)).all()
    assert (turned[:, 1] == rows[:, :32].sum(1) - rows[:, 32:].sum(1)).all()


def test_progressive_search_is_exact_with_ties():
    random = np.random.default_rng(2)
    vectors, points = random.integers(-3, 4, (500, 16)), random.integers(-3, 4, (9, 16))
    points[5] = points[2]
    best, distance = centroids.nearest(centroids.transform(vectors), centroids.transform(points))
    plain = ((vectors[:, None] - points[None]) ** 2).sum(-1)
    assert (best == plain.argmin(1)).all() and (distance == 16 * plain.min(1)).all()


def test_clusters_like_plain_rounds(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(i % 5, 0.3, 64).tolist()) for i in range(300)]
    # repeated rows and ids, a third of all rows on one vector, and rows that take no part
    rows += [(7, rows[3][1])] * 150 + [(None, rows[4][1])]
    rows += [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [1.0] * 63 + [float("nan")]), (904, [float("inf")] * 64)]
    compare_clusters(spark, rows)


def test_clusters_of_few_and_huge_vectors(spark):
    compare_clusters(spark, [(i, [float(i)] * 64) for i in range(3)])
    huge = [(i, [x * (-1) ** i for x in ([1e300] * 32 + [float(i)] * 32)]) for i in range(12)]
    compare_clusters(spark, huge + [(100 + i, [i / 7] * 64) for i in range(12)])
    compare_clusters(spark, [(i, [i * 20000.0] * 64) for i in range(20)], k=3, rounds=4)
    empty = found_clusters(spark, [(1, None)])
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


# -- licences -------------------------------------------------------------------------------------

TEMPLATES = {"one": ("a rare wording of ten words that is the first",), "two": ("some words twice some words", "b c"), "é": ("É b",)}
PHRASES = {"cc by": "cc-by", "by by cc": "odd", "all rights reserved": "reserved"}


def plain_scan(text, templates, phrases, percent):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = split(text)
    places = []
    for phrase, label in phrases.items():
        spelt = split(phrase)
        places += [(i, label) for i in range(len(words)) if words[i : i + len(spelt)] == spelt]
    blocks, number = [], 0
    for label, wordings in templates.items():
        for wording in wordings:
            size, held = len(split(wording)), set(split(wording))
            for start in range(0, len(words), size):
                shared = len(held & set(words[start : start + 2 * size]))
                if 100 * shared >= percent * len(held):
                    blocks.append((label, number, start, shared / len(held)))
            number += 1
    return len(words), sorted(places), blocks


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_scan_like_every_block(spark, percent):
    random = np.random.default_rng(percent)
    pool = ["a", "rare", "wording", "of", "ten", "words", "that", "is", "the", "first", "some", "twice", "b", "c", "cc", "by", "all", "rights", "reserved"]
    pool += ["É", "é", "filler", "A", "BY", "CC", "x1", "K"]
    texts = [" ".join(random.choice(pool, int(n))) for n in random.integers(0, 60, 300)]
    texts += [None, "", "!!", "cc", "cc by", "CC-BY\x00cc\nby", "by by by cc by by cc", "cc by " * 3000, "x " * 20000 + "all rights reserved"]
    texts += ["A rare wording of ten words that is the first."] * 40
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 2)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, blocks int"), TEMPLATES, PHRASES, percent)
    got = found.collect()
    assert found.columns == ["doc_id", "text", "n_words", "places", "blocks"] and len(got) == len(rows)
    for r in got:
        n, places, blocks = plain_scan(r.text, TEMPLATES, PHRASES, percent)
        assert r.n_words == n
        assert sorted((p.start, p.label) for p in r.places) == places
        assert [tuple(b) for b in r.blocks] == blocks


def test_scan_without_templates_rows_or_words(spark):
    docs = spark.createDataFrame([(1, "cc by", 5)], "doc_id long, text string, n_words int")
    row = licences.scan(docs, {}, {}, prefix="found_").first()
    assert (row.n_words, row.found_n_words, row.found_places, row.found_blocks) == (5, 2, [], [])
    assert licences.scan(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        licences.scan(docs, {"none": ("--",)})


def test_scan_runs_without_python_or_shuffle_of_texts(spark):
    plan = QUERIES["op12_licences"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# -- alignment ------------------------------------------------------------------------------------


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    rows = []
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a, bytes_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append((0, 0, [], ""))
            continue
        groups, links, x, y = [], [], 0, 0
        while x < len(ids_a):
            i, j, end_a, end_b = x, y, 0, 0
            while end_a != end_b or not end_a:
                if end_a <= end_b:
                    end_a, i = end_a + len(bytes_a[i]), i + 1
                else:
                    end_b, j = end_b + len(bytes_b[j]), j + 1
            groups.append(f"{','.join(map(str, ids_a[x:i]))}|{','.join(map(str, ids_b[y:j]))}")
            links.append((ids_a[i - 1], ids_b[j - 1]))
            x, y = i, j
        rows.append((len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(link for row in rows for link in row[2])
    highest = Counter()
    for (_, b_id), n in counts.items():
        highest[b_id] = max(highest[b_id], n)
    return [
        (n_a, n_b, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for n_a, n_b, links, digest in rows
    ]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_odd_texts(spark):
    texts = [None, "", " ", "  two  spaces ", "a", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ as a letter", "naïve Straße 日本語 \U0001f600",
             "tab\tline\n\n end", "a\x00b", "ﬁ ligature ½ Å", "1234567890", "don't we'll"]
    texts += ["copies of one text"] * 60 + ["copies of one  text"] * 3
    rows = [(i % 20, t, i) for i, t in enumerate(texts)]
    found = alignment.align(
        spark.createDataFrame(rows, "doc_id long, text string, n_best int").withColumn("at", F.col("n_best")).repartition(4),
        tokenizer_path(), tokenizer_path("piece_bpe_32k.model"),
    )
    assert found.columns == ["doc_id", "text", "at", *NAMES]
    got = {r["at"]: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, expected in enumerate(plain_alignment(texts)):
        assert got[i].text == texts[i] and tuple(got[i][n] for n in NAMES) == expected, texts[i]


def test_alignment_query_like_plain_loop(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = Counter((r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text for r in rows]), strict=True))
    got = Counter((r.doc_id, *(r[n] for n in NAMES)) for r in QUERIES["op13_alignment"](spark, SF).collect())
    assert got == expected


def test_texts_are_cut_into_words_without_a_trace(monkeypatch):
    both = alignment.tokenizers(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    assert both.apart
    words = np.random.default_rng(4).choice(["some", "words", "and", "x1", "  ", "don't", "end.\n", "é", "," * 9, "\u0301", "\x1c", "　", "日本"], 4000)
    texts = [" ".join(words), "", "next one", " ", " ".join(words[:9]), "x" * 5000]
    assert " ".join(both.words(texts[0])) == texts[0] and len(both.words(texts[0])) > 1000
    monkeypatch.setattr(both, "apart", False)
    whole = both.align(texts)
    monkeypatch.undo()
    for kept in (10**6, 0):
        monkeypatch.setattr(alignment, "KEPT_WORDS", kept)
        known = alignment.AlignedWords(both)
        known.align(texts[3:])
        for x, y in zip(whole, known.align(texts), strict=True):
            assert list(x) == list(y)


def test_every_linked_pair_is_possible():
    both = alignment.tokenizers(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    # the bound on what is collected and broadcast: the tokens' endings
    assert len(both.pairs) < both.length_a.sum() + both.length_b.sum()
    *_, links = both.align(["Übergröße and naïve <|endoftext|> 日本 \U0001f600 zażółć"])
    pairs = both.pairs[links]
    for a, b in zip((pairs & 0xFFFFFFFF).tolist(), (pairs >> 32).tolist(), strict=True):
        x, y = both.bytes_a[a], both.bytes_b[b]
        assert x.endswith(y) or y.endswith(x)


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).collect() == []
