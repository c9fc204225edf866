"""Connected components by repeated contraction, as DataFrame joins.

Each round every node points to the smallest of itself and its neighbours, the
pointers are followed once more, and the edges are rewritten to the nodes pointed
to. Rounds go on until no edge is left; the pointers are then composed backwards.
Every level is a stored table, so lost executors recompute from files, and hot
nodes meet only partial aggregates or joins that the planner can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import stored


def _undirected(e: DataFrame, a: str, b: str) -> DataFrame:
    return (e.where(F.col(a) != F.col(b))
            .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): the smallest node reachable. Only nodes
    with a link to another node come back; loops and nulls are ignored."""
    e = stored(_undirected(edges, "u", "v"), "cc-edges")
    levels = []
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = stored(both.groupBy("u").agg(F.min("v").alias("m"))
                   .select(F.col("u").alias("node"), F.least("u", "m").alias("to")), "cc-near")
        nxt = p.select(F.col("node").alias("to"), F.col("to").alias("far"))
        q = stored(p.join(nxt, "to").select("node", F.col("far").alias("to")), "cc-level")
        levels.append(q)
        qu = q.select(F.col("node").alias("u"), F.col("to").alias("a"))
        qv = q.select(F.col("node").alias("v"), F.col("to").alias("b"))
        e = stored(_undirected(e.join(qu, "u").join(qv, "v"), "a", "b"), "cc-edges")
    if not levels:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = levels[-1].select("node", F.col("to").alias("component"))
    for level in reversed(levels[:-1]):
        far = out.select(F.col("node").alias("to"), F.col("component").alias("c"))
        out = stored(level.join(far, "to", "left")
                     .select("node", F.coalesce("c", "to").alias("component")), "cc-out")
    return out
