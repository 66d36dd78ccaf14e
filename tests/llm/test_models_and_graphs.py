"""Mixing, tool calls, URL verdicts, language, toxicity and the pipeline."""

import json
import os
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinsieve.llm import language, mixing, toolcalls, toxicity, urlgraph
from kinsieve.llm.queries import URL_RULES, tokenizer_path

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("weights,other", [({"a": 3, "b": 1}, 1), ({"a": 7, "c": 2}, 5), ({}, 1)])
def test_mix_keeps_all_rows_and_stays_within_a_block(spark, monkeypatch, weights, other):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 37)
    sizes = {"a": 400, "b": 90, "c": 200, "d": 3, None: 50, "": 20}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, "x"))
            i += 1
    rows += [rows[0], (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = mixing.mix(df, weights, other, block_rows=4).collect()
    assert sorted(((r.doc_id, r.source) for r in got), key=str) == sorted(((i, s) for i, s, _ in rows), key=str)
    assert all(r.release <= r.slot < r.deadline for r in got)
    weight = {s: weights.get(s, other) for s in sizes}
    total = sum(weight.values())
    runs = defaultdict(dict)
    for r in got:
        assert runs[r.source].setdefault(r.block, r.slot) == r.slot
    slots = {slot: s for s, blocks in runs.items() for slot in blocks.values()}
    assert len(slots) == sum(map(len, runs.values()))
    for s, blocks in runs.items():
        assert sorted(blocks) == list(range(len(blocks)))
        for t in range(max(blocks.values()) + 1):
            done = sum(slot <= t for slot in blocks.values())
            assert abs(done - weight[s] * (t + 1) / total) < 1
    positions = [r.position for r in got]
    assert len(set(positions)) == len(positions)


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty, {"a": 2}).count() == 0
    assert mixing.in_mixed_order(empty, {}).columns == empty.columns
    with pytest.raises(ValueError):
        mixing.mix(empty, {"a": 0})


def test_mixed_order_is_the_order_of_files(spark, tmp_path):
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    mixing.in_mixed_order(df, {"a": 1}, block_rows=10).write.parquet(str(tmp_path / "out"))
    laid = [r.source for f in sorted((tmp_path / "out").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert len(laid) == 2_000
    for start in range(0, 1_200, 100):
        assert laid[start : start + 100].count("a") == 50


def test_tool_calls(spark):
    calls = [
        (1, 1, "a", "search", '{"query":"x","limit":3}', None),
        (1, 9, "b", "search", '{"limit":3,"query":"ü"}', ["c"]),
        (1, 2, "c", "note", '{"text":"t","kind":"long"}', ["a", "gone"]),
        (1, 3, "d", "note", '{"text":"t","kind":"odd"}', []),
        (1, 4, "d", "note", '{"text":"u","kind":"long"}', []),
        (1, 4, "d", "note", '{"text":"u","kind":"long"}', []),
        (2, 1, "a", "measure", '{"words":1,"ratio":true}', ["b"]),
        (2, 2, "b", "measure", '{"words":1}', ["a"]),
        (2, 3, "e", "other", "{}", ["a"]),
        (3, 1, "a", "measure", "[1", None),
        (3, 2, "b", None, None, ["b"]),
        (3, 3, "n", "measure", '{"words":NaN}', None),
        (None, 1, "a", "search", "{}", None),
    ]
    results = [(1, 5, "a", "late"), (1, 2, "a", "early"), (1, 3, "c", None), (1, 3, "b", "r"), (1, 4, "d", "r"), (3, 2, "a", "r"), (3, 4, "n", "r"), (9, 1, "z", "r")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame([(*x, "extra") for x in results], "conv_id long, turn long, call_id string, content string, level string")
    got = {(x.conv_id, x.call_id, x.turn): x for x in toolcalls.link(c, r, toolcalls.SCHEMAS).collect()}
    status = {k: (v.level, v.status) for k, v in got.items()}
    assert status == {
        (1, "a", 1): (0, "ok"),
        (1, "c", 2): (1, "ok"),
        (1, "b", 9): (2, "ok"),
        (1, "d", 3): (0, "kind is not allowed"),
        (1, "d", 4): (None, "repeated call"),
        (2, "a", 1): (None, "cycle"),
        (2, "b", 2): (None, "cycle"),
        (2, "e", 3): (None, "cycle"),
        (3, "a", 1): (0, "arguments are not JSON"),
        (3, "b", 2): (None, "cycle"),
        (3, "n", 3): (0, "arguments are not JSON"),
        (9, "z", 1): (None, "orphan result"),
    }
    assert got[1, "b", 9].message == '{"call":{"arguments":{"limit":3,"query":"ü"},"id":"b","name":"search"},"result":"r"}'
    assert json.loads(got[1, "a", 1].message)["result"] == "early"
    assert toolcalls.link(c.limit(0), r.limit(0), toolcalls.SCHEMAS).count() == 0


@tables
def test_arguments_without_a_canonical_form(spark):
    odd = ['{"words":1,"ratio":1e400}', '{"words":' + "9" * 5_000 + "}", '{"words":' + "[" * 100_000 + "]" * 100_000 + "}"]
    odd += ['{"words":1,"x":"\\ud800"}', '{"words":NaN}', '{"words":1']
    rows = [(1, i, f"c{i}", "measure", a, []) for i, a in enumerate(odd)]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    answers = spark.createDataFrame([(1, i, f"c{i}", "done") for i in range(len(odd))], "conv_id long, turn long, call_id string, content string")
    got = {r.turn: r for r in toolcalls.link(calls, answers, toolcalls.SCHEMAS).collect()}
    assert [got[i].status for i in range(6)] == ["arguments have no canonical form"] * 4 + ["arguments are not JSON"] * 2
    assert [json.loads(got[i].message)["call"]["arguments"] for i in range(6)] == odd


def test_derived_calls_against_plain_python(spark):
    chats = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    calls, results = toolcalls.from_conversations(chats)
    got = {(r.conv_id, r.turn, r.call_id): r for r in toolcalls.link(calls, results, toolcalls.SCHEMAS).collect()}
    plain = {(r.conv_id, r.call_id): r for r in calls.collect()}
    answers = {(r.conv_id, r.call_id): r.content for r in results.collect()}
    assert len(got) == len(plain) + len(set(answers) - set(plain))

    def depth(call):
        return max([depth(plain[call.conv_id, d]) + 1 for d in call.depends_on if (call.conv_id, d) in plain], default=0)

    for key, call in plain.items():
        row = got[call.conv_id, call.turn, call.call_id]
        value, wrong = toolcalls.problem(call.arguments, toolcalls.SCHEMAS[call.name])
        assert row.level == depth(call)
        assert row.status == ("no result" if key not in answers else wrong or "ok")
        assert json.loads(row.message).get("result") == answers.get(key)


def test_url_parts_and_rules(spark):
    urls = [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/enx", "example.net", "/enx", "net/", "block"),
        ("http://badexample.net", "badexample.net", "", None, "allow"),
        ("http://x.com://y/de/", "x.com:", "//y/de/", None, "allow"),
        ("ftp://example.com/de/?a=://b", "example.com", "/de/", "example.com/de/", "block"),
        ("http://ÄB.org/fr/#?x", "Äb.org", "/fr/", "org/fr/", "allow"),
        ("mailto:a@b", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://org/fr/1\n2", "org", "/fr/1\n2", "org/fr/", "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urlgraph.judge(df, URL_RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), urls[i]
    assert urlgraph.judge(df.limit(0), URL_RULES).count() == 0


def test_link_graph_against_plain_iteration(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.com" for i in range(12)] + ["bad.net", "good.org"]
    rows = []
    for i in range(120):
        host = rng.choice(hosts)
        links = [f'<a HREF="//{rng.choice(hosts).upper()}/p">' for _ in range(rng.randint(0, 3))]
        rows.append((i, f"http://{host}/fr/{i}", f"<a href='/own'>{''.join(links)}<img src=http://bad.net?x>" if i % 9 == 0 else "".join(links)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: (r.trust, r.distrust) for r in urlgraph.judge(df, URL_RULES).collect()}
    edges = defaultdict(int)
    import re

    for _, url, html in rows:
        a = url.split("/")[2]
        for b in re.findall(r"""(?i)(?:href|src)=["']?(?:http:)?//([^/?"'>]+)""", html):
            if b.lower() != a:
                edges[a, b.lower()] += 1
    out, into = defaultdict(int), defaultdict(int)
    for (a, b), n in edges.items():
        out[a] += n
        into[b] += n
    seed = {h: (float(h == "good.org"), float(h == "bad.net")) for h in hosts}
    now = dict(seed)
    for _ in range(urlgraph.ROUNDS):
        fresh = {h: list(seed[h]) for h in hosts}
        for (a, b), n in edges.items():
            fresh[b][0] += urlgraph.DAMPING * now[a][0] * n / out[a]
            fresh[a][1] += urlgraph.DAMPING * now[b][1] * n / into[b]
        now = fresh
    for h, (trust, distrust) in got.items():
        assert trust == pytest.approx(now[h][0], abs=0.02) and distrust == pytest.approx(now[h][1], abs=0.02)


def test_link_graph_reaches_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(25)], "a string, b string, n long")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h25", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in urlgraph.propagate(edges, seeds).collect()}
    assert len(got) == 26
    for i in range(26):
        assert got[f"h{i}"] == pytest.approx((urlgraph.DAMPING**i, urlgraph.DAMPING ** (25 - i)))


@tables
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "123 !!", "en"), (-3, "", None), (None, "the and", "en"), (-4, "日本" * 9, None)], "doc_id long, text string, lang string")
    got = language.identify(docs.select("doc_id", "text", "lang").unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == docs.count() + 5
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got)
    named = {r.doc_id: r.lang_pred for r in got}
    assert named[-1] == named[-2] == named[-3] == "und" and named[None] == "en" and named[-4] in {"de", "en", "es", "fr"}


@pytest.mark.parametrize("most", [1 << 26, 1 << 22])
def test_language_filter_is_sized_for_its_ngrams(spark, monkeypatch, most):
    monkeypatch.setattr(language, "MOST_SLOTS", most, raising=False)
    rng = np.random.default_rng(6)
    # an alphabet of 8,000 signs: about 1.5 million 4-grams, each three times, and 500 of them often
    signs = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 8_000, 1_000))) for _ in range(1_500)]
    often = [signs[0][:500] * 3] * 40
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    known = [word() for _ in range(200)]
    latin = [" ".join(rng.choice(known, 40)) for _ in range(400)]
    rows = [(t, "signs") for t in signs * 3 + often] + [(t, "latin") for t in latin]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string").repartition(8))
    assert model[0] == ["latin", "signs"]
    assert all(0 < ((model[1][:, 0] >> i) & 1).mean() <= 0.3 for i in range(2))
    texts = [*((t, "latin") for t in latin[:50]), (signs[0][:500], "signs")]
    texts += [(t[:200], "signs") for t in signs[1:50]] if most > 1 << 22 else []
    got = language.predict(spark.createDataFrame(texts, "text string, want string"), model).collect()
    assert all(r.lang_pred == r.want and r.score > 0.9 for r in got)


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(4, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.identify(df).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0)).count() == 0


@tables
def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else FOLDER
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None, "x"), (None, "abc", "x"), (-1, "", "y")], "doc_id long, text string, score string")
    rows = docs.select("doc_id", "text").withColumn("score", F.lit("x")).unionByName(odd)
    more = labels.unionByName(labels.limit(5)).unionByName(labels.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "quality", "toxic"))
    got = toxicity.classify(rows, more).withColumn("held_out", toxicity.held_out()).join(labels, "doc_id", "left").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.toxic is not None]
    positive, negative = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    above = sum(p > n for p in positive for n in negative) / (len(positive) * len(negative))
    assert above > 0.9
    assert sum(n >= 0.5 for n in negative) <= 0.03 * len(negative)


def test_toxicity_training_brings_used_features_only(spark, monkeypatch):
    def words(i: int) -> str:
        rare = " ".join("".join(chr(97 + int(d)) for d in str(1000 * i + j)) + f" {chr(97 + i % 26)}" for j in range(300))
        return f"{rare} awful rotten" if i < 40 else f"{rare} lovely"

    docs = spark.createDataFrame([(i, words(i)) for i in range(120)], "doc_id long, text string").repartition(5)
    brought, collect = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: brought.append(collect(df)) or brought[-1])
    known = docs.filter("doc_id < 40").select("doc_id")
    weights, base = toxicity.train(docs, known, 0.3)
    # counts by hand
    texts = sorted(docs.collect())
    seen, usual = np.zeros(toxicity.DIMENSIONS), np.zeros(toxicity.DIMENSIONS)
    for r in texts:
        found = toxicity.features(pa.array([r.text]))[1]
        usual[found] += 1
        if r.doc_id < 40:
            seen[found] += 1
    used = (seen >= 3) & (seen / 40 >= toxicity.LEAST_LIFT * usual / 120)
    assert used.sum() > 4 and not weights[~used].any() and (weights[used] != 0).all()
    entries = sum(used[toxicity.features(pa.array([r.text]))[1]].sum() * (1 + (r.doc_id < 40)) for r in texts)
    assert sum(len(x) for t in brought for x in t.column("words").to_pylist()) == 4 * entries
    # the layout of the rows changes nothing
    again = toxicity.train(docs.repartition(2, "doc_id"), known, 0.3)
    assert (again[0] == weights).all() and again[1] == base


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.classify(docs, labels).collect()] == [0, 0]
    assert toxicity.classify(docs.limit(0), labels.limit(0)).count() == 0


@tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(2).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars")
    long = docs.limit(1).select(F.lit(10**12).alias("doc_id"), F.repeat(F.lit("mot "), 50_000).alias("text"), "lang", "source", "n_chars")
    rows = docs.unionByName(odd).unionByName(long).withColumn("score", F.lit(1)).withColumn("slot", F.lit("x")).withColumn("component", F.lit(2.0))
    first = {r.doc_id: r.text for r in rows.collect()}
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, "/root/testdata/sf0.001")
        assert after.columns == rows.columns and after.schema["n_chars"].dataType == rows.schema["n_chars"].dataType
        ids = [r.doc_id for r in after.collect()]
        assert ids.count(None) == 2 and 10**12 in ids and set(ids) <= set(first)
        kept = corpus_pipeline.written(after, name)
    out = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in out.collect())
    assert out.count() == kept.count() and kept.count() >= 0.8 * len(first)
    empty = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


@tables
def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 150 and os.path.exists(tokenizer_path())


def test_pipeline_run_follows_the_mix(spark, tmp_path):
    rng = random.Random(9)
    # src1 runs out after 900 rows; the rest of src0, in the last files, is the largest part if its texts are sorted so
    docs = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(30)), "en", "src1" if i % 5 == 4 else "src0") for i in range(1_500)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    late = mixing.mix(docs, corpus_pipeline.MIX_WEIGHTS).filter("position > 1400").select(F.col("doc_id").alias("late"))
    long = F.concat("text", F.repeat(F.concat(F.lit(" "), F.sha2("text", 512)), 1), *[F.concat(F.lit(" "), F.sha2(F.concat("text", F.lit(str(i))), 512)) for i in range(20)])
    docs = docs.join(late, docs.doc_id == late.late, "left").withColumn("text", F.when(F.col("late").isNotNull(), long).otherwise(F.col("text"))).drop("late")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a file per partition, as with large data
    try:
        rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(rows) == 1_500
    for t in range(32, 900, 32):
        assert abs(sum(r.source == "src0" for r in rows[:t]) - t * 2 / 3) <= 32
    assert [r.position for r in rows] == list(range(1_500))


def test_toxicity_features_of_pieces(monkeypatch):
    import pyarrow as pa

    words = ["Word", "another", "ünd", "x", "letters1and2digits", "verylongword" * 3]
    texts = ["", None, " ".join(words * 40), "word", "", "a" * 500, " ".join(reversed(words * 9)), " "]
    whole = toxicity.features(pa.array(texts))
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 50)
    for x, y in zip(whole, toxicity.features(pa.array(texts)), strict=True):
        assert x.tolist() == y.tolist()


def _words(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.getrandbits(30):x}" for _ in range(n)]


@pytest.mark.parametrize("shift", [0, 2**63 - 20])
def test_near_copies_go_by_id_and_text(spark, shift):
    x, y, z = (" ".join(_words(i)) for i in range(3))
    near = " ".join([*_words(2)[:-1], "other"])
    given = [(2, x), (5, x), (5, z), (7, near), (9, y), (9, y), (9, z), (None, x), (None, x), (11, None), (11, None), (11, "")]
    given += [(12, " ".join(_words(12))), (12, " ".join(_words(13)))]
    docs = spark.createDataFrame([(None if i is None else i + shift, t, "en") for i, t in given], "doc_id long, text string, lang string")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id is None, r.doc_id and r.doc_id - shift, r.text) for r in kept.collect()), key=str)
    want = [(2, x), (5, z), (9, y), (None, x), (None, x), (11, None), (11, ""), (12, given[-2][1]), (12, given[-1][1])]
    assert got == sorted(((i is None, i, t) for i, t in want), key=str)


def test_stages_leave_extra_columns_alone(spark):
    names = ["slot", "block", "release", "deadline", "position", "n_bytes", "kept", "n_removed", "n_spans", "ids", "score", "n_chars"]
    passage = " ".join(_words(50))
    rows = [(i, " ".join(_words(i)) + " " + passage, "en", f"s{i % 2}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names[:-1]}).withColumn("n_chars", F.length("text").cast("long"))
    for stage in (corpus_pipeline.keep_one_of_near_copies, corpus_pipeline.cut_repeated_passages, corpus_pipeline.mix_sources):
        after = stage(spark, docs, "")
        assert after.columns == docs.columns
        got = after.collect()
        assert len(got) == 30 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names[:-1])
        assert all(r.n_chars == len(r.text) for r in got)
