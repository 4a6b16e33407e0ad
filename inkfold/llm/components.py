"""Connected components by repeated hooking: every vertex takes its least neighbour, edges follow, until none are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of the edges (a, b): label is the same within a component, and one of its ids.

    A round at least halves the vertices that are left, so there are at most log2 of them; near-duplicate groups, which come
    as stars, take two or three. Nothing but the number of edges left reaches the driver."""
    maps: list[DataFrame] = []
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    first = left
    while not left.isEmpty():
        # the edges are distinct with a < b: minima are combined before the shuffle, whatever a vertex's degree
        both = left.select(F.col("b").alias("id"), F.col("a").alias("to")).union(left.select(F.col("a").alias("id"), F.col("a").alias("to")))
        hook = written(both.groupBy("id").agg(F.min("to").alias("to")), "hooks")
        maps.append(hook)
        moved = left.join(hook.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(hook.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        left = written(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    if not maps:
        return first.select(F.col("a").alias("id"), F.col("a").alias("label"))
    out = maps[0].select("id", F.col("to").alias("label"))
    for m in maps[1:]:
        step = m.select(F.col("id").alias("label"), F.col("to").alias("next"))
        out = out.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    return written(out, "labels")
