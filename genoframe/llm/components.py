"""Connected components with DataFrame operations only.

Stars are enlarged and shrunk in turn: first every node's larger neighbours are
linked to its smallest neighbour, then every node's smaller neighbours are. The
edges end as stars around each component's smallest node, after a number of
rounds that grows with the logarithm of the longest path; rounds go on until no edge
changes. Minima are aggregated before they are shuffled and written as a table. They
are broadcast if they are few; else a hub's edges meet its minimum in a join of two
plain shuffles, which adaptive execution can split. Each round's edges are a written
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm.scratch import Scratch

#: Rows up to which a round's minima are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) of every node that an
    edge joins to another one. Nodes are of any type that has an order; null ends, loops
    and repeated edges count for nothing."""
    scratch = scratch or Scratch(edges.sparkSession)
    x, y = F.col(a), F.col(b)
    now = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"), x.isNotNull().alias("x"), y.isNotNull().alias("y"))
    now = scratch.table(now.where("x AND y AND u <> v").select("u", "v").distinct(), "edges")
    state, before = _state(now), None

    def meet(edges: DataFrame, least: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
        least = scratch.table(least, "least")
        # there are no more nodes than ends of edges
        few = 2 * state[0] <= BROADCAST_ROWS or least.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return edges.join(F.broadcast(least) if few else least, on), least

    while state[0] and state != before:
        # larger neighbours of a node go to the least of the node and its neighbours
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        met, least = meet(both.where("y > x"), both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "x")
        large = scratch.table(met.select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        scratch.drop(now, least)
        # smaller neighbours of a node, and the node, go to the least of them
        met, least = meet(large, large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.table(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(large, least)
        before, state = state, _state(now)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
