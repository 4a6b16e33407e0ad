"""Reading-order trees: nesting, paths, pre-order, continuity, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEEPEST = 4


def heading_parents(items: DataFrame, keys: list[str], ix: str = "ix", level: str = "level") -> DataFrame:
    """Adds parent_ix: the nearest heading before a heading of a lesser level, or before any other item at all; null at the top."""
    w = Window.partitionBy(*keys).orderBy(ix).rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col(level) == k, F.col(ix)), ignorenulls=True).over(w) for k in range(1, DEEPEST + 1)}
    out = items
    for k, c in last.items():
        out = out.withColumn(f"_l{k}", c)
    above = lambda k: F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(f"_l{j}", F.lit(-1)) for j in range(1, k)))
    parent = F.when(F.col(level).isNull(), above(DEEPEST + 1))
    for k in range(1, DEEPEST + 1):
        parent = parent.when(F.col(level) == k, above(k))
    return out.withColumn("parent_ix", F.nullif(parent, F.lit(-1))).drop(*(f"_l{k}" for k in last))


def sibling_paths(nodes: DataFrame, depth: int) -> DataFrame:
    """nodes (id, parent, kind, pos): adds path - kind[n] tokens from the root, n counting siblings of the kind - and order, the
    sibling places, for pre-order. One self-join a level."""
    w = Window.partitionBy("parent", "kind").orderBy("pos")
    n = nodes.withColumn("tok", F.concat(F.col("kind"), F.lit("["), F.row_number().over(w).cast("string"), F.lit("]")))
    done = level = n.where("parent IS NULL").select("id", "parent", "kind", F.concat(F.lit("/"), F.col("kind")).alias("path"), F.array("pos").alias("order"))
    for _ in range(depth):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("_p"), F.col("order").alias("_o"))
        level = n.join(up, "parent").select("id", "parent", "kind", F.concat("_p", F.lit("/"), "tok").alias("path"), F.concat("_o", F.array("pos")).alias("order"))
        done = done.unionByName(level)
    return done


def continuation(ends_hyphen: Column, ends_terminal: Column, starts_lower: Column, same_height: Column, same_width: Column, adjacent: Column) -> Column:
    """struct<score, evidence>: whether a paragraph goes on in the next. Evidence stands in the rubric's order."""
    signs = [(ends_hyphen, 3, "ends_hyphen"), (~ends_terminal, 1, "no_terminal"), (F.coalesce(starts_lower, F.lit(False)), 2, "starts_lower"), (same_height, 1, "height_match"), (same_width, 1, "width_match"), (adjacent, 2, "adjacency")]
    score = sum((F.when(c, w).otherwise(0) for c, w, _ in signs), F.lit(0))
    told = F.array_join(F.filter(F.array(*(F.when(c, F.lit(n)) for c, _, n in signs)), lambda x: x.isNotNull()), ",")
    return F.struct(score.alias("score"), told.alias("evidence"))


EDGE_LEAST, CONFIRM_LEAST = 5, 4


def windows(nodes: DataFrame, keys: list[str], order: str, cap: int = 48, carry: int = 4) -> DataFrame:
    """Cuts nodes into windows of ``cap`` and repeats the last ``carry`` of each as context of the next: window, place, context."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = nodes.withColumn("_r", F.row_number().over(w) - 1).withColumn("window", F.floor(F.col("_r") / cap))
    total = F.count("*").over(Window.partitionBy(*keys))
    n = n.withColumn("_t", total)
    own = n.withColumn("context", F.lit(False))
    late = n.where((F.col("_r") % cap >= cap - carry) & ((F.col("window") + 1) * cap < F.col("_t"))).withColumn("window", F.col("window") + 1).withColumn("context", F.lit(True))
    both = own.unionByName(late)
    place = F.row_number().over(Window.partitionBy(*keys, "window").orderBy("_r")) - 1
    return both.withColumn("place", place).drop("_r", "_t")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def kendall(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pairs, discordant pairs and the permille of agreement of two orders within each key, without making the pairs: two places of
    the second order differ first in one bit, and there the later of the first order has the lower one. One running sum a bit; places
    of the second order are numbers of zero or more, those of the first differ."""
    own = Window.partitionBy(*keys)
    x = pairs.select(*keys, F.col(a).alias("_a"), F.col(b).cast("long").alias("_b")).withColumn("_bits", F.length(F.bin(F.max("_b").over(own))))
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    x = x.withColumns({"_high": F.expr("shiftright(_b, _k + 1)"), "_bit": F.expr("shiftright(_b, _k) & 1")})
    before = Window.partitionBy(*keys, "_k", "_high").orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_over", F.when(F.col("_bit") == 0, F.coalesce(F.sum("_bit").over(before), F.lit(0))).otherwise(0))
    g = x.groupBy(*keys).agg(F.count_if(F.col("_k") == 0).alias("_n"), F.sum("_over").cast("long").alias("discordant"))
    g = g.where("_n > 1").withColumn("pairs", F.expr("_n * (_n - 1) div 2"))
    return g.select(*keys, "pairs", "discordant", F.floor((F.col("pairs") - 2 * F.col("discordant")) * 1000 / F.col("pairs")).cast("long").alias("tau_pm"))


def conflicts(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Sibling sections that disagree with geometry, page by page. leaves: keys, section (in stated order), page, band, col_x0, col_x1.
    Two sections conflict on a page if they share a column - each covers most of the other - and their bands overlap by more than a
    third of the shorter, or the earlier one starts lower. Sections are pre-aggregated, so pairs are of sections, not of leaves."""
    col = F.struct(F.col("col_x0").alias("x0"), F.col("col_x1").alias("x1"))
    s = leaves.groupBy(*keys, "page", "section").agg(F.min("band").alias("lo"), F.max("band").alias("hi"), F.collect_set(col).alias("cols"))
    name = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("section", "lo", "hi", "cols")]
    j = s.select(*keys, "page", *name("a")).join(s.select(*keys, "page", *name("b")), [*keys, "page"]).where("a_section < b_section")
    inter = lambda a, b: F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    same = F.exists("a_cols", lambda a: F.exists("b_cols", lambda b: (2 * inter(a, b) > a["x1"] - a["x0"]) & (2 * inter(a, b) > b["x1"] - b["x0"])))
    shared = F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo") + 1
    shorter = F.least(F.col("a_hi") - F.col("a_lo"), F.col("b_hi") - F.col("b_lo")) + 1
    return j.where(same & (((shared > 0) & (3 * shared > shorter)) | (F.col("a_lo") > F.col("b_lo")))).select(*keys, "page", "a_section", "b_section")


FURNITURE_RANK = {"pageHeader": 0, "pageNumber": 1, "pageFooter": 2}


def furniture_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Furniture in order of page, role, top, left and index: adds pos (from 0). Without geometry top and left count as 0."""
    rank = F.coalesce(*(F.when(F.col("role") == k, F.lit(v)) for k, v in FURNITURE_RANK.items()), F.lit(3))
    w = Window.partitionBy(*keys).orderBy("page", rank, F.coalesce("y0", F.lit(0)), F.coalesce("x0", F.lit(0)), "block_ix")
    return blocks.withColumn("pos", F.row_number().over(w) - 1)


def review_reason(has_bands: Column, most_frames: Column, fallback_pages: Column, ties: Column, provider_sections: Column, most_band: Column, body_nodes: Column) -> Column:
    """Why a tree deserves a second opinion, or why it does not (no_geometry, clean_single_column)."""
    return (
        F.when(~has_bands, "no_geometry")
        .when(most_frames >= 2, "multi_frame")
        .when(fallback_pages > 0, "coverage_fallback")
        .when(ties > 0, "order_ties")
        .when((provider_sections == "absent") & (most_band >= 1) & (body_nodes > 10), "sectionless_multiband")
        .otherwise("clean_single_column")
    )


def deserves_review(reason: Column) -> Column:
    return ~reason.isin("no_geometry", "clean_single_column")
