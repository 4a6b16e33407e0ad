"""Small rules of the layout model: what counts once, what is refused, what may be named how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: More than one in fifty of slope is skewed; roles that a leaf does not keep, since its kind says them.
STEEPEST = 50
SAID_BY_KIND = ("title", "sectionHeading", "footnote")
INPUTS = ("document", "read", "layout", "envelope")


def distinct_atoms(atoms: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Atoms without exact copies, which have the same rectangle and text: the first in order stays, and takes the first tag of its
    copies if it has none. Shadows and doubled type are such copies."""
    w = Window.partitionBy(*keys, "x0", "y0", "x1", "y1", "text").orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = F.first(F.nullif(F.col("tag"), F.lit("")), ignorenulls=True).over(whole)
    return atoms.withColumns({"_n": F.row_number().over(w), "_tag": given}).where("_n = 1").withColumn("tag", F.coalesce("_tag", F.lit(""))).drop("_n", "_tag")


def top_edge(quad: Column) -> Column:
    """struct<rise, run> of a quad's top edge in milli-units, run being one at least; level without eight numbers."""
    edge = F.struct((G.mu(quad[3]) - G.mu(quad[1])).alias("rise"), F.greatest(G.mu(quad[2]) - G.mu(quad[0]), F.lit(1).cast("long")).alias("run"))
    return F.when(F.size(quad) >= 8, edge).otherwise(F.struct(F.lit(0).cast("long").alias("rise"), F.lit(1).cast("long").alias("run")))


def page_skew(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, rise, run, skewed) of the line of the lower median slope of a page (columns rise and run, the top edge); skewed if that
    rises by more than a fiftieth."""
    slope = F.abs("rise") / F.col("run")
    s = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(slope.alias("s"), *order, "rise", "run"))).alias("l"))
    mid = F.element_at("l", F.expr("cast((size(l) - 1) div 2 as int) + 1"))
    m = s.select(*keys, mid.alias("m")).select(*keys, "m.rise", "m.run")
    return m.withColumn("skewed", F.abs("rise") * STEEPEST > F.col("run"))


def safe_role(role: Column) -> Column:
    """A role that is one short token and is not said by the leaf's kind; else null."""
    return F.when(role.rlike(r"\A[A-Za-z][A-Za-z0-9_.-]{0,63}\z") & ~role.isin(*SAID_BY_KIND), role)


def safe_doc_id(doc_id: Column) -> Column:
    return F.when(doc_id.rlike(r"\A[A-Za-z0-9._:-]{0,128}\z"), doc_id).otherwise("")


def may_be_uuid(value: Column) -> Column:
    """Whether a value can address a row: 32 hexadecimal digits, with hyphens or braces or without, but no URN."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), r"\A\{|\}\z", ""), "-", "")
    return F.coalesce(~F.lower(value).contains("urn:") & bare.rlike(r"\A[0-9a-f]{32}\z"), F.lit(False))


def one_input(*supplied: Column) -> Column:
    """struct<source, status>: the one input that is given, or 400 if it is none or several. Columns stand in the order of INPUTS."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in supplied), F.lit(0))
    which = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in zip(INPUTS, supplied)))
    return F.struct(F.when(n == 1, which).alias("source"), F.when(n == 1, 200).otherwise(400).alias("status"))


def figure_ids(figures: DataFrame, keys: list[str]) -> DataFrame:
    """Figures (keys, page, figure_ix, y0, x0) with figure_id: numbered from one on their page by top, left and index; without geometry
    top and left count as 0."""
    w = Window.partitionBy(*keys, "page").orderBy(F.coalesce("y0", F.lit(0)), F.coalesce("x0", F.lit(0)), "figure_ix")
    return figures.withColumn("figure_id", F.concat(F.lit("fig-"), F.col("page").cast("string"), F.lit("-"), F.row_number().over(w).cast("string")))


def tag_histogram(markdown: DataFrame, text: str = "markdown") -> DataFrame:
    """(tag, n) of all anchors of all documents."""
    tags = F.regexp_extract_all(F.col(text), F.lit(r"<!-- @\d+ \[-?\d+,-?\d+,-?\d+,-?\d+\] ([^ ]+)[^\n]* -->"), F.lit(1))
    return markdown.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tree_heading(text: Column, depth: Column) -> Column:
    """A heading of a tree: two hashes at the top, one more for each level, six at most."""
    return F.concat(F.repeat(F.lit("#"), (1 + F.least(F.greatest(depth, F.lit(1)), F.lit(5))).cast("int")), F.lit(" "), F.when(text.startswith("#"), F.concat(F.lit("\\"), text)).otherwise(text))
