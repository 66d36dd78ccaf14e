"""URL filters: rules for what is known, link-graph propagation for the rest.

Trust flows along links from hosts whose pages the rules allow; distrust flows against them, to the hosts that
link to what the rules block. Both are personalised PageRanks over the edges between hosts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinsieve.session import written

DAMPING = 0.85
SETTLED = 1e-4
ROUNDS = math.ceil(math.log(SETTLED, DAMPING)) + 1  # after these a seed's mass moves nothing by more than SETTLED
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""

Rule = tuple[str, str]


def host_of(url: str) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: Sequence[Rule], value: int) -> Column:
    """The part (0: verdict, 1: rule) of the longest rule that fits the columns host and path. Of equally long
    ones the first in alphabetical order wins. The list of rules becomes one expression: it must be short."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        host, slash, path = rule[1].partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith(f".{host}")
        found = F.when(fits & F.col("path").startswith(slash + path), F.lit(rule[value])).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts with their number: a (linking), b (linked), n. Relative links stay within
    a host and are no edge. Links are counted before the shuffle, so a much-linked host is no burden."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("b"))
    links = links.select(F.col("host").alias("a"), F.translate("b", UPPER, LOWER).alias("b"))
    return links.filter((F.col("a") != F.col("b")) & (F.col("a") != "")).groupBy("a", "b").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Trust and distrust of every host, in units of a seed: host, trust, distrust.

    `seeds` has the same columns. A host passes DAMPING of its trust on to the hosts it links to, and of its
    distrust to those that link to it, in proportion to the number of links. Every round is one join and one
    aggregate, written to the shared folder; the rounds end when nothing moves by more than SETTLED. Their
    bound grows with the logarithm of the mass of all seeds, as one host may gather it.
    """
    forward = edges.join(edges.groupBy("a").agg(F.sum("n").alias("all")), "a")
    back = edges.join(edges.groupBy("b").agg(F.sum("n").alias("all")), "b")
    flows = forward.select(F.lit("trust").alias("kind"), F.col("a").alias("source"), F.col("b").alias("host"), (F.col("n") / F.col("all")).alias("share"))
    flows = written(
        flows.unionByName(back.select(F.lit("distrust").alias("kind"), F.col("b").alias("source"), F.col("a").alias("host"), (F.col("n") / F.col("all")).alias("share"))),
        "flows",
    )
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "mass"))
    start = written(start.filter("mass > 0"), "seeds")
    now = start
    mass = start.agg(F.sum("mass")).first()[0] or 0.0
    for _ in range(ROUNDS + math.ceil(math.log(1 / max(1.0, mass), DAMPING))):
        moved = flows.join(now.withColumnRenamed("host", "source"), ["kind", "source"]).select("kind", "host", (F.col("mass") * F.col("share") * DAMPING).alias("mass"))
        following = moved.unionByName(start.select("kind", "host", "mass")).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        following = written(following, "ranks")
        change = following.withColumnRenamed("mass", "new").join(now, ["kind", "host"], "left")
        most = change.agg(F.max(F.abs(F.col("new") - F.coalesce("mass", F.lit(0.0))))).first()[0] or 0.0
        now = following
        if most <= SETTLED:
            break
    else:
        raise RuntimeError("ranks did not settle")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule], threshold: float = THRESHOLD) -> DataFrame:
    """A verdict for every page: page_id, host, path, rule, verdict, trust, distrust.

    `rules` are (verdict, host/path) pairs; a rule fits its host and all subdomains where the path starts with
    its path, and the longest one decides. Other pages are blocked if their host's distrust exceeds its trust
    by more than the threshold. A host is a seed of trust (distrust) by the share of its pages that the rules
    allow (block). A missing url or one without :// has an empty host and path, no rule, and is allowed; a
    missing html has no links. Rows repeat as they come; other columns are left out.
    """
    placed = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), "html")
    ruled = placed.drop("html").withColumns({"rule": matched(rules, 1), "by_rule": matched(rules, 0)})
    share = lambda v: F.avg((F.coalesce("by_rule", F.lit("")) == v).cast("double"))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = propagate(host_edges(placed), seeds)
    found = ruled.join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_graph = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), "trust", "distrust")
