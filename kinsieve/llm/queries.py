"""One named query per operator: the operator with production parameters over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinsieve.llm import (
    alignment,
    bpe,
    centroids,
    fingerprints,
    jaccard,
    language,
    licences,
    mixing,
    suffixes,
    toolcalls,
    topk,
    toxicity,
    urlgraph,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The installed public tokenizer file; KINSIEVE_TOKENIZERS names another folder."""
    folder = os.environ.get("KINSIEVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLES["op1_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = bpe.encode_and_decode(docs, tokenizer_path())
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    compared = fingerprints.compare_with_next(table(spark, folder, "documents").select("doc_id", "text"))
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return compared.select(
        "doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query
def op5_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = toolcalls.from_conversations(table(spark, folder, "conversations"))
    return toolcalls.link(calls, results, toolcalls.SCHEMAS)


# parts of the mix: the large source gets twice the share of each other one
MIX_WEIGHTS = {"src0": 2}


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mixing.mix(docs, MIX_WEIGHTS)


@query
def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@query
def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urlgraph.judge(table(spark, folder, "pages").select("page_id", "url", "html"), URL_RULES)


@query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents").select("doc_id", "text", "lang"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.classify(docs, table(spark, folder, "labels"))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256")
    )


def _centroids_sql(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """The rounds written out one by one; (a - b) ** 2 summed as whole numbers, means floored without division of doubles."""
    apart = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    nearest = f"""(SELECT vec_id, any_value(e) AS e, arg_min(c, (d, c)) AS c, min(d) AS d
      FROM (SELECT v.vec_id, v.e, c.c, CAST({apart} AS HUGEINT) AS d FROM v, {{centroids}} c) GROUP BY vec_id)"""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
          FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT e, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(1, rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED {nearest.format(centroids=f'c{i - 1}')}")
        steps.append(
            f"""c{i} AS MATERIALIZED (SELECT o.c, coalesce(n.e, o.e) AS e FROM c{i - 1} o LEFT JOIN (
              SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS HUGEINT) ORDER BY i) AS e FROM (
                SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i}) GROUP BY c, i
              ) GROUP BY c) n ON o.c = n.c)"""
        )
    steps.append(f"final AS MATERIALIZED {nearest.format(centroids=f'c{rounds}')}")
    return f"""WITH {', '.join(steps)}
    SELECT vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.e, lambda x: x::VARCHAR), ',')) AS centroid_sha256
    FROM final f JOIN c{rounds} c ON f.c = c.c"""


ORACLES["op11_centroids"] = _centroids_sql()


@query
def op12_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(table(spark, folder, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("blocks", lambda b: b["label"]))).alias("labels"),
        # a phrase that stands in full is held in full
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licences_sql(percent: int = 80) -> str:
    """Every block of every wording against every text, without candidates."""
    listed = [(label, wording) for label, wordings in licences.TEMPLATES.items() for wording in wordings]
    wordings = ", ".join(f"({_quoted(label)}, {_quoted(wording)})" for label, wording in listed)
    phrases = ", ".join(f"({_quoted(label)}, {_quoted(phrase)})" for phrase, label in licences.PHRASES.items())
    split = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {split.format('text')} AS words FROM documents),
    w AS (SELECT label, words, len(words) AS size, list_distinct(words) AS held FROM (SELECT label, {split.format('wording')} AS words FROM (VALUES {wordings}) t(label, wording))),
    p AS (SELECT label, {split.format('phrase')} AS words FROM (VALUES {phrases}) t(label, phrase)),
    b AS (SELECT row, label, held, words[block * size + 1 : block * size + 2 * size] AS part
      FROM (SELECT d.row, d.words, w.label, w.held, w.size, unnest(range(0, (len(d.words) + w.size - 1) // w.size)) AS block FROM d, w)),
    m AS (SELECT row, label, shared / size AS containment FROM (SELECT row, label, len(held) AS size, len(list_intersect(held, part)) AS shared FROM b) WHERE 100 * shared >= {percent} * size),
    q AS (SELECT row, label, start FROM (SELECT d.row, d.words, p.label, p.words AS spelt, unnest(range(0, len(d.words))) AS start FROM d, p)
      WHERE words[start + 1] = spelt[1] AND words[start + 1 : start + len(spelt)] = spelt),
    base AS (SELECT row, count(*) AS n, min(start) AS first, max(start) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM q GROUP BY row),
    every AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS best
      FROM (SELECT row, label, containment FROM m UNION ALL SELECT row, label, 1.0::DOUBLE FROM q) GROUP BY row)
    SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, first AS first_word, last AS last_word, coalesce(base.labels, '') AS base_labels,
      coalesce(every.labels, '') AS labels, CAST(coalesce(best, 0.0) AS DOUBLE) AS score
    FROM d LEFT JOIN base ON d.row = base.row LEFT JOIN every ON d.row = every.row"""


ORACLES["op12_licences"] = _licences_sql()


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).drop("text")
