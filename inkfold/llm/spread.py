"""Laying rows out by an ordered key without one task for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_points(df: DataFrame, key: str, parts: int) -> list:
    """At most parts-1 existing key values that cut the rows about evenly; reads the key column alone."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    row = df.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, at, max(10_000, 20 * parts)).alias("p"), F.min(key).alias("m")).first()
    return sorted({x for x in (row["p"] or []) if x is not None and x > row["m"]})


def shard_of(key: Column, points: list) -> Column:
    """Number of split points not above the key; nulls come first. A binary search as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(points[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(tree(0, len(points)))
