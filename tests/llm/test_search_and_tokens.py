"""Exact search against brute force; BPE against the tokenizers library."""

import math
import random

import pytest

from kinsieve.llm import bpe, topk
from kinsieve.llm.queries import tokenizer_path


def whole(vector):
    return [math.floor(1024 * x) for x in vector]


def brute_force(rows, asked, k):
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    found = []
    queries = {}
    for i, v in asked:
        if i is not None and fine(v):
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        scores = [
            (-sum(a * b for a, b in zip(whole(v), whole(w))), i)
            for i, w in rows
            if i is not None and i != q and fine(w) and len(w) == len(v)
        ]
        found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(found)


@pytest.mark.parametrize("rows_per_tile", [7, 8_192])
def test_top_k_equals_brute_force(spark, monkeypatch, rows_per_tile):
    monkeypatch.setattr(topk, "TILE_ROWS", rows_per_tile)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3333]) for _ in range(4)]) for i in range(90)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (204, [1.0, 2.0]), (205, []), (7, [0.25] * 4), (8, [1e30, -1e30, 1e30, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, df.filter("vec_id % 10 < 3"), k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    limits = (-(2**63), 2**63 - 1)
    want = [(q, r, i, min(max(s, limits[0]), limits[1])) for q, r, i, s in brute_force(rows, [r for r in rows if r[0] is not None and r[0] % 10 < 3], 5)]
    assert sorted(map(tuple, got.collect())) == want


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).count() == 0


PIECES = ["'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "é", "日本", "12", "½", "word", " Word", "!!", " ", "<|endoftext|>", "😀", "aaaaaaaa", "\x00"]


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += ["x" * 50_000, "ab " * 20_000, "", None, "", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path()).collect()
    assert len(got) == len(texts)
    for row in got:
        want = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert [int.from_bytes(row.ids[i : i + 4], "little") for i in range(0, len(row.ids), 4)] == want
        assert row.decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_of_every_token_and_bad_bytes(spark):
    vocab = bpe.vocabulary(tokenizer_path())
    assert all(ids == [vocab.ids[word]] for word, ids in vocab.encode_words(vocab.ids))
    half = vocab.ids[b"\xe6"].to_bytes(4, "little")
    df = spark.createDataFrame([(bytearray(half),), (None,)], "ids binary")
    assert [r.decoded for r in bpe.decode(df, tokenizer_path()).collect()] == ["�", ""]
    assert bpe.encode(spark.createDataFrame([], "text string"), tokenizer_path()).count() == 0


def test_bpe_round_trip_takes_one_worker(spark):
    texts = ["".join(PIECES) * i for i in range(5)] + ["", None]
    df = spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(texts)], "doc_id int, text string, ids string, decoded string")
    both = bpe.encode_and_decode(df, tokenizer_path())
    want = bpe.decode(bpe.encode(df, tokenizer_path()).drop("text"), tokenizer_path())
    assert both.columns == ["doc_id", "ids", "decoded"]
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, want.select(*both.columns).collect()))
    assert bpe.encode_and_decode(df.limit(0), tokenizer_path()).count() == 0


def test_queries_encode_and_decode_in_one_worker(spark, tmp_path):
    from corpus_pipeline import write_tokens
    from kinsieve.llm.queries import QUERIES

    docs = spark.createDataFrame([(1, "a b", "en", "web")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    placed = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for df in (QUERIES["op2_bpe"](spark, str(tmp_path)), write_tokens(spark, placed, str(tmp_path))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
