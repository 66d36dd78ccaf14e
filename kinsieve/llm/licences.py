"""Licence scans: an exact set-similarity join of text blocks with licence templates, in SQL functions only.

Words are ordered by how many documents hold them, rarest first. A template that shares enough words with a block
shares one of its rarest words with it (prefix filter), so only blocks around such words are looked at; of those the
ones with too few known words (length filter) or whose first shared word leaves too few words behind it on either side
(positional filter) are passed over, and the rest is counted. Templates are a bounded parameter that travels with the plan, so
texts are never shuffled and a row's result depends on its text alone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# parameters of the registered query: phrases that are found word by word, and wordings found by containment
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu general public license",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee",),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    "mpl": ("this source code form is subject to the terms of the mozilla public license",),
    "public-domain": ("this is free and unencumbered software released into the public domain",),
}


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; a missing text has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lowered, NO_WORD), lambda w: w != "")


def _texts(items: Sequence[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def _numbers(items: Sequence[int]) -> Column:
    return F.array(*map(F.lit, items))


def document_frequencies(docs: DataFrame, text: str, words: Sequence[str]) -> dict[str, int]:
    """How many rows hold each of the given words. The result is as small as the list of words."""
    known = F.array_distinct(F.filter(words_of(F.col(text)), lambda w: w.isin(*words)))
    counted = docs.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {word: 0 for word in words} | {row["word"]: row["n"] for row in counted}


def scan(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    percent: int = 80,
    text: str = "text",
    prefix: str = "",
) -> DataFrame:
    """Add n_words, places (label, start) and blocks (label, template, start, containment) to each row.

    `phrases` maps a phrase to its label: its words must stand consecutively, and every place is listed in the order of
    the text. `templates` maps a label to wordings. A text is cut into blocks per wording: of twice its number of words,
    one beginning every such number of words, so that any run of as many words as the wording has lies in a block. A
    block is listed if it holds at least `percent` of a wording's distinct words; `template` numbers the wordings from 0
    as given, `start` is the block's first word (from 0). Both are whole: no cap, no sample.

    A missing or empty text has no words and empty lists. Rows that repeat are judged one by one, an empty table
    gives no rows. Extra columns are kept; one that is called like an output column is replaced, unless `prefix` gives
    the outputs another name. Texts of any length are taken whole. Wordings and phrases are lower-cased and split like
    texts; without words they are an error. Phrases and wordings together are meant to be some hundreds.
    """
    listed = [(label, wording) for label, wordings in templates.items() for wording in wordings]
    shape = [(label, _split(wording)) for label, wording in listed]
    spelt = [(label, _split(phrase)) for phrase, label in phrases.items()]
    if not all(words for _, words in shape + spelt):
        raise ValueError("a template or phrase has no words")
    vocabulary = sorted({w for _, words in shape + spelt for w in words})
    frequency = document_frequencies(docs, text, vocabulary) if vocabulary else {}
    order = sorted(vocabulary, key=lambda w: (frequency[w], w))
    rank = {w: i + 1 for i, w in enumerate(order)}

    # a prefix entry per template and rare word; phrases must be held in full, so their rarest word is the prefix
    rare: set[str] = set()
    entries, wordings = [], []
    for number, (label, words) in enumerate(shape):
        ranks = sorted({rank[w] for w in words})
        need = -(-percent * len(ranks) // 100)
        leading = ranks[: len(ranks) - need + 1]
        rare |= {order[r - 1] for r in leading}
        entries += [(order[r - 1], number, len(words)) for r in leading]
        wordings.append((label, len(words), need, ranks, leading))
    anchors = []
    for label, words in spelt:
        rarest = min(words, key=lambda w: rank[w])
        rare.add(rarest)
        anchors.append((label, rarest, words.index(rarest), words))

    names = {name: prefix + name for name in ("n_words", "places", "blocks")}
    kept = docs.drop(*names.values())
    listed_words, hits = "__licence_words", "__licence_hits"
    out = kept.withColumn(listed_words, words_of(F.col(text)))
    words = F.col(listed_words)
    where = F.transform(words, lambda w, i: F.when(w.isin(*sorted(rare)), F.struct(i.alias("at"), w.alias("word"))))
    found = F.filter(where, lambda h: h.isNotNull()) if rare else F.array().cast("array<struct<at:int,word:string>>")
    out = out.withColumn(hits, found)
    out = out.withColumns(
        {
            names["n_words"]: F.size(words).cast("long"),
            names["places"]: _places(words, F.col(hits), anchors),
            names["blocks"]: _blocks(words, F.col(hits), entries, wordings, order),
        }
    )
    return out.drop(listed_words, hits)


def _split(text: str) -> list[str]:
    """The words of a phrase or wording, as `words_of` finds them in a text."""
    lowered = text.translate(str.maketrans(UPPER, UPPER.lower()))
    return [w for w in re.split(NO_WORD, lowered) if w]


def _places(words: Column, hits: Column, anchors) -> Column:
    """Where a phrase stands: its rarest word gives a candidate, its words in a row decide."""
    kind = "array<struct<label:string,start:long>>"
    if not anchors:
        return F.array().cast(kind)
    listed = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(word).alias("word"), F.lit(before).alias("before"), _texts(spelt).alias("spelt"))
            for label, word, before, spelt in anchors
        ]
    )

    def of_hit(hit):
        def stands(a):
            begin = hit["at"] - a["before"]
            there = F.slice(words, F.greatest(begin, F.lit(0)) + 1, F.size(a["spelt"]))
            return (a["word"] == hit["word"]) & (begin >= 0) & (there == a["spelt"])

        place = lambda a: F.struct(a["label"].alias("label"), (hit["at"] - a["before"]).cast("long").alias("start"))
        return F.transform(F.filter(listed, stands), place)

    def by_start(x, y):
        return F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["label"] < y["label"], -1).when(x["label"] > y["label"], 1).otherwise(0)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, of_hit))), by_start).cast(kind)


def _blocks(words: Column, hits: Column, entries, wordings, order) -> Column:
    """Blocks that hold enough of a wording: candidates around rare words, filters, then the count."""
    kind = "array<struct<label:string,template:int,start:long,containment:double>>"
    if not entries:
        return F.array().cast(kind)
    index = F.array(
        *[F.struct(F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(size).alias("size")) for w, t, size in entries]
    )
    shapes = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"), F.lit(size).alias("size"), F.lit(need).alias("need"),
                _numbers(ranks).alias("ranks"), _numbers(leading).alias("leading"),
            )
            for label, size, need, ranks, leading in wordings
        ]
    )
    known = _texts(order)

    def around(hit):
        def two(e):
            block = F.floor(hit["at"] / e["size"]).cast("int")
            return F.array(*[F.struct(e["template"].alias("template"), (block - back).alias("block")) for back in (0, 1)])

        return F.flatten(F.transform(F.filter(index, lambda e: e["word"] == hit["word"]), two))

    candidates = F.array_distinct(F.flatten(F.transform(hits, around)))
    candidates = F.filter(candidates, lambda c: c["block"] >= 0)

    def with_ranks(c):
        shape = F.get(shapes, c["template"])
        held = F.array_distinct(F.slice(words, c["block"] * shape["size"] + 1, shape["size"] * 2))
        held = F.filter(held, lambda w: w.isin(*order))
        ranks = F.array_sort(F.transform(held, lambda w: F.array_position(known, w).cast("int")))
        return F.struct(c["template"].alias("template"), c["block"].alias("block"), shape.alias("shape"), ranks.alias("ranks"))

    def long_enough(c):
        return F.size(c["ranks"]) >= c["shape"]["need"]

    def well_placed(c):
        # the first shared word in the common order is one of the leading ones, if enough words are shared
        first = F.array_min(F.array_intersect(c["ranks"], c["shape"]["leading"]))
        behind = lambda ranks: F.size(ranks) - F.array_position(ranks, first).cast("int")
        return 1 + F.least(behind(c["ranks"]), behind(c["shape"]["ranks"])) >= c["shape"]["need"]

    def counted(c):
        shared = F.size(F.array_intersect(c["ranks"], c["shape"]["ranks"]))
        return F.struct(
            c["shape"]["label"].alias("label"),
            c["template"].alias("template"),
            (c["block"] * c["shape"]["size"]).cast("long").alias("start"),
            (shared / F.size(c["shape"]["ranks"])).alias("containment"),
            (shared >= c["shape"]["need"]).alias("enough"),
        )

    judged = F.transform(F.filter(F.filter(F.transform(candidates, with_ranks), long_enough), well_placed), counted)
    enough = F.filter(judged, lambda b: b["enough"])
    plain = F.transform(
        enough,
        lambda b: F.struct(
            b["label"].alias("label"), b["template"].alias("template"), b["start"].alias("start"), b["containment"].alias("containment")
        ),
    )

    def by_template(x, y):
        before = (x["template"] < y["template"]) | (x["template"] == y["template"]) & (x["start"] < y["start"])
        same = (x["template"] == y["template"]) & (x["start"] == y["start"])
        return F.when(same, 0).when(before, -1).otherwise(1)

    return F.array_sort(plain, by_template).cast(kind)
