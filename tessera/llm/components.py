"""Connected components of a graph held in DataFrames, by repeated contraction.

Each round gives every node the smallest of itself and its neighbours, by a round's own random order, and contracts
along those choices; edges inside a contracted node go. The graph shrinks by a constant factor a round, whatever its
diameter. Minima are aggregated in part before the shuffle, and edges meet choices in plain joins, so a node with a
third of all edges is split by adaptive execution. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def _order(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)).alias("at"), node.alias("node"))


def label(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long): nodes share a root exactly if they are connected."""
    edges = shared.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(steps)
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")
        nearest = ends.groupBy("x").agg(F.min(F.struct(F.xxhash64("y", F.lit(turn)).alias("at"), F.col("y").alias("node"))).alias("least"))
        chosen = shared.table(nearest.select(F.col("x").alias("node"), F.least(_order(F.col("x"), turn), F.col("least"))["node"].alias("next")), f"choice-{turn}")
        steps.append(chosen)
        first = edges.join(chosen.withColumnRenamed("node", "a"), "a").select(F.col("next").alias("a"), "b")
        both = first.join(chosen.withColumnRenamed("node", "b"), "b").select("a", F.col("next").alias("b"))
        before, edges = edges, shared.table(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"edges-{turn}")
        shared.forget(before)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last round back: where a round's choices lead in the end
    ends_at = steps[-1].withColumnRenamed("next", "root")
    for chosen in reversed(steps[:-1]):
        later = ends_at.withColumnRenamed("node", "next")
        before, ends_at = ends_at, shared.table(chosen.join(later, "next", "left").select("node", F.coalesce("root", "next").alias("root")), "roots")
        shared.forget(chosen, before)
    return ends_at
