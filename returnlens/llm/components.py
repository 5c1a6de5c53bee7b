"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the edges (a, b); the component is its smallest id.

    Each round every node moves to the neighbour that comes first in an order drawn anew by hashing, and the edges are
    contracted. The expected number of nodes falls by a constant factor a round, also on long chains, so the rounds grow
    with the logarithm of the longest chain. Nodes with many edges are reduced before the shuffle. Every round is written,
    so a lost executor costs at most the round in work.
    """
    left = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    moves = []
    turn = 0
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("id"))
        to = settle(both.groupBy("a").agg(F.min(order).alias("best")).select("a", F.least("best", own)["id"].alias("to")), "moves")
        moves.append(to)
        ends = left.join(to.select("a", F.col("to").alias("x")), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = settle(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
    if not moves:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = moves[0].select(F.col("a").alias("id"), F.col("to").alias("at"))
    for to in moves[1:]:
        found = found.join(to.select(F.col("a").alias("at"), "to"), "at", "left").select("id", F.coalesce("to", "at").alias("at"))
    found = settle(found, "labels")
    least = found.groupBy("at").agg(F.min("id").alias("component"))
    return settle(found.join(least, "at").select("id", "component"), "components")
