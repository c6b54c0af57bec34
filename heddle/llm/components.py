"""Connected components of an edge table, by rounds of hooking and contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(v, root) for every end of an edge (a, b); all of a component have one root, one of its vertices.

    In a round each vertex takes the least of itself and its neighbours, in an order by hash, then that one's own
    choice; edges get the chosen ends and are made distinct. The number of vertices at least halves in the mean, so
    few rounds are needed whatever the shape. Only minima and joins by vertex are used, no group is collected, and
    each round's tables are written. Null ends, loops and repeated edges don't matter.
    """

    def vertex(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    live = edges.where("a is not null and b is not null").select(vertex("a").alias("a"), vertex("b").alias("b"))
    live = scratch.put(live.distinct(), f"{name}_edges0")
    chosen: list[DataFrame] = []
    k = 0
    while True:
        ends = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("p"))
        up = scratch.put(first, f"{name}_up{k}")
        jumped = up.alias("x").join(up.alias("y"), F.expr("x.p = y.v"), "left").select(F.col("x.v").alias("v"), F.coalesce("y.p", "x.p").alias("p"))
        jumped = scratch.put(jumped, f"{name}_jump{k}")
        chosen.append(jumped)
        left = live.join(jumped.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
        both = left.join(jumped.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        k += 1
        live = scratch.put(both.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}_edges{k}")
        scratch.drop(f"{name}_edges{k - 1}", f"{name}_up{k - 1}")
        if live.isEmpty():
            break
    roots = chosen[0]
    for step in chosen[1:]:
        roots = roots.alias("x").join(step.alias("y"), F.expr("x.p = y.v"), "left").select(F.col("x.v").alias("v"), F.coalesce("y.p", "x.p").alias("p"))
    return roots.select(F.col("v.v").alias("v"), F.col("p.v").alias("root"))
