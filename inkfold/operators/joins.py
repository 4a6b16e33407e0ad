"""Range, containment, nearest and positional joins as equi-joins on buckets or as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Spans are met in buckets of so many offsets, so that a long document's join is not quadratic.
BUCKET = 1024


def _bucketed(df: DataFrame, off: str, length: str) -> DataFrame:
    last = F.floor((F.col(off) + F.greatest(F.col(length), F.lit(1)) - 1) / BUCKET)
    return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(off) / BUCKET), last)))


def span_join(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each line (doc_id, line_ix, off, len) with the overlapping block (doc_id, block_ix, off, len) that begins first, then has the
    least block_ix; lines that no block overlaps are left out. Lines and blocks of several spans have a row for each; where a block's
    lowest offset is not its row's it stands in a column low. The least pair makes meeting in many buckets harmless."""
    a = _bucketed(lines.select("doc_id", "line_ix", "off", "len"), "off", "len")
    low = F.col("low" if "low" in blocks.columns else "off").alias("b_low")
    b = _bucketed(blocks.select("doc_id", "block_ix", low, F.col("off").alias("b_off"), F.col("len").alias("b_len")), "b_off", "b_len")
    hit = a.join(b, ["doc_id", "_b"]).where(G.spans_overlap(F.col("off"), F.col("len"), F.col("b_off"), F.col("b_len")))
    best = hit.groupBy("doc_id", "line_ix").agg(F.min(F.struct("b_low", "block_ix")).alias("m"))
    return best.select("doc_id", "line_ix", F.col("m.block_ix").alias("block_ix"))


def overlap_semi(items: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Items (off, len) that overlap any span of the same keys."""
    a = _bucketed(items, "off", "len")
    b = _bucketed(spans.select(*keys, F.col("off").alias("s_off"), F.col("len").alias("s_len")), "s_off", "s_len")
    on = [a[k] == b[k] for k in [*keys, "_b"]]
    return a.join(b, [*on, G.spans_overlap(a["off"], a["len"], b["s_off"], b["s_len"])], "left_semi").drop("_b").distinct()


def first_containing(points: DataFrame, ranges: DataFrame, keys: list[str], inside: Column, ix: str, id_cols: list[str]) -> DataFrame:
    """Each point with the least index of the ranges of its keys that contain it, or null."""
    hit = points.join(ranges, keys, "left").groupBy(*keys, *id_cols).agg(F.min(F.when(inside, F.col(ix))).alias(ix))
    return hit


def frame_of(centre: Column, frames: DataFrame) -> Column:
    """Over rows joined with their frames: the first frame whose right edge reaches the centre, else the last."""
    return F.coalesce(F.min(F.when(centre <= F.col("frame_x1"), F.col("frame_ix"))), F.max("frame_ix"))


def unclaimed(items: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(claims.select(*keys).distinct(), keys, "left_anti")


def claims_exact(universe: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Entities that are not claimed just once, with their number of claims; empty when all is well."""
    n = claims.groupBy(*keys).agg(F.count("*").alias("claims"))
    both = universe.withColumn("_u", F.lit(1)).join(n, keys, "full_outer").withColumn("claims", F.coalesce("claims", F.lit(0).cast("long")))
    return both.where((F.col("claims") != 1) | F.col("_u").isNull()).withColumn("known", F.col("_u").isNotNull()).drop("_u")


def gap_clusters(items: DataFrame, keys: list[str], lo: str, hi: str, gap: Column, order: list[str]) -> DataFrame:
    """Sessions: a new cluster begins where an item starts more than the gap below all before it."""
    w = Window.partitionBy(*keys).orderBy(lo, *order)
    top = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(top.isNotNull() & (F.col(lo) - top > gap), 1).otherwise(0)
    return items.withColumn("_cut", cut).withColumn("cluster", F.sum("_cut").over(w)).drop("_cut")
