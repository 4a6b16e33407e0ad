"""Plain text as layout: blocks without geometry, and fixed-pitch pages. One row in, one row's children out: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The fixed-pitch page.
COLUMNS, ROWS, TAB = 78, 54, 8
WIDTH, HEIGHT, MARGIN, LEADING, ADVANCE, SIZE = 612, 792, 72, 12, 6, 10


def blocks_of(text: Column) -> Column:
    """The stripped lines that are not blank."""
    return F.filter(F.transform(T.split_lines(text), T.strip), lambda x: x != "")


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_ix, text): one body block for each line that is not blank."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(blocks_of(F.col(text_col))).alias("block_ix", "text"))


def with_pages(docs: DataFrame, text_col: str = "text", out: str = "pages") -> DataFrame:
    """Adds pages as arrays of rows: a form feed ends a page, lines are cut hard, blank lines take a row; one page at least.

    Each step is a column of its own: an expression inside a lambda is worked out wherever it is named."""
    d = docs.withColumn("_parts", F.split(F.coalesce(F.col(text_col), F.lit("")), "\f", -1))
    d = d.withColumn("_lines", F.transform("_parts", lambda c: F.transform(T.split_lines(c), lambda x: T.rstrip(T.expand_tabs(x, TAB)))))
    cut = lambda t: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(t) - 1, F.lit(0)) / COLUMNS).cast("int")), lambda i: F.substring(t, i * COLUMNS + 1, F.lit(COLUMNS)))
    d = d.withColumn("_rows", F.transform("_lines", lambda c: F.flatten(F.transform(c, cut))))
    d = d.withColumn("_rows", F.filter("_rows", lambda r: F.size(r) > 0))
    paged = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / ROWS).cast("int")), lambda p: F.slice(r, p * ROWS + 1, F.lit(ROWS)))
    d = d.withColumn("_pages", F.flatten(F.transform("_rows", paged)))
    none = F.array(F.array().cast("array<string>"))
    return d.withColumn(out, F.when(F.size("_pages") > 0, F.col("_pages")).otherwise(none)).drop("_parts", "_lines", "_rows", "_pages")


def wrap_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, page, row, text) of all rows, blank ones included."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pages = with_pages(src).select("doc_id", F.posexplode("pages").alias("p", "rows"))
    return pages.select("doc_id", (F.col("p") + 1).alias("page"), F.posexplode("rows").alias("row", "text"))


def row_rects(rows: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1 in points to rows that are not blank; the others go."""
    lead = F.length("text") - F.length(T.lstrip(F.col("text")))
    x0 = F.lit(MARGIN) + ADVANCE * lead
    y1 = F.lit(MARGIN) + LEADING * (F.col("row") + 1)
    full = rows.where(F.col("text") != "")
    return full.withColumns({"x0": x0.cast("long"), "y0": (y1 - SIZE).cast("long"), "x1": (F.lit(MARGIN) + ADVANCE * F.length("text")).cast("long"), "y1": y1.cast("long")})
