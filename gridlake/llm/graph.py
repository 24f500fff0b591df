"""Distributed connected components by contraction, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridlake.llm.tables import cut


def _tidy(edges: DataFrame) -> DataFrame:
    return (edges.where(F.col("a") != F.col("b"))
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; ``component`` is
    the smallest node reachable.  Loops, repeated and null-ended edges are ignored
    (a node with loops only is absent).

    Each round maps every node to the smallest of itself and its neighbours in a
    hashed order and contracts the graph by that map; the number of rounds is
    logarithmic in expectation, also for long chains, and a hub is one grouped
    minimum (combined before the shuffle) plus a join that adaptive execution can
    split.  Every round is written to shared storage; nothing is collected.
    """
    current = cut(_tidy(edges.select("a", "b").dropna()), f"{name}-edges", edges.count())
    maps: list[DataFrame] = []
    while rows := current.count():
        seed = F.lit(len(maps) // 2)
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), seed).alias("h"), F.col(c).alias("n"))
        both = current.union(current.select("b", "a"))
        # a plan over the written edges; the joins below share its exchange
        step = (both.groupBy(F.col("a").alias("node"))
                    .agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("n"))).alias("m"))
                    .select("node", F.least(ranked("node"), F.col("m"))["n"].alias("to")))
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        current = cut(_tidy(current.join(left, "a").join(right, "b")
                                   .select(F.col("x").alias("a"), F.col("y").alias("b"))), f"{name}-edges", rows)
        nodes = 2 * rows if len(maps) == 1 else nodes
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("root"), "to")
        labels = labels.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    labels = cut(labels, f"{name}-labels", nodes)
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(smallest, "root").select("node", "component")
