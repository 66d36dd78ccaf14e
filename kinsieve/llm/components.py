"""Connected components of an edge list, by alternating contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinsieve.session import written

ROUNDS = 60


def _smaller_first(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.select(high.alias("a"), low.alias("b")).filter(F.col("a") != F.col("b"))


def _upward(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its least neighbour, or to itself if that is smaller."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    least = edges.select(ends).groupBy(F.col("e.a").alias("b")).agg(F.least(F.min("e.b"), F.col("b")).alias("least"))
    return edges.join(least, "b").select("a", F.col("least").alias("b"))


def _downward(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    node = F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b"))
    return edges.join(least, "a").select(node.alias("a"), F.col("least").alias("b")).distinct()


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """The component of every node that has an edge: node, component (its smallest node).

    `edges` has the long columns a and b; direction, repeats and loops do not matter, rows with a missing end
    are left out. Large and small steps alternate until only stars are left, which takes a number of rounds
    that grows with the logarithm of the longest path. Only a minimum is kept per node, so a node with very many
    neighbours is no burden for one task. Each step is written to the shared folder: plans that hold a step several
    times over cost the driver memory and time.
    """
    edges = _smaller_first(edges.dropna(subset=["a", "b"]).select("a", "b")).distinct()
    edges = written(edges, label)
    before = None
    for _ in range(ROUNDS):
        edges = written(_upward(edges), label)
        edges = written(_downward(edges), label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
