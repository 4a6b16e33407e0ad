"""Position-anchored markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..session import written
from ..sources import texts

FORMAT = "inkfold/1"


def front_matter(fields: dict[str, Column]) -> Column:
    """Lines of key: value between rules; empty and null values are left out."""
    lines = [F.when(v.cast("string") != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def wrapped_markdown(docs: DataFrame) -> DataFrame:
    """Text laid out on fixed-pitch pages as markdown with an anchor for each row. Everything of a document is made inside its
    own row: no shuffle, whatever its size. doc_id, pages, blocks, chars, markdown, sha256_markdown, sha256_input."""
    d = texts.with_pages(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))

    def row(page: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            lead = F.length(s) - F.length(T.lstrip(s))
            y1 = F.lit(texts.MARGIN) + texts.LEADING * (i + 1)
            a = T.anchor(page, F.lit(texts.MARGIN) + texts.ADVANCE * lead, y1 - texts.SIZE, F.lit(texts.MARGIN) + texts.ADVANCE * F.length(s), y1, F.lit("p"))
            return F.when(s != "", F.concat(a, F.lit("\n"), T.clean(s), F.lit("\n\n"))).otherwise("")

        return one

    marker = lambda p: T.page_marker(p, F.lit(float(texts.WIDTH)), F.lit(float(texts.HEIGHT)), F.lit("point"))
    body = F.array_join(F.transform("pages", lambda rows, p: F.concat(marker(p + 1), F.lit("\n\n"), F.array_join(F.transform(rows, row(p + 1)), ""))), "")
    d = d.withColumn("body", body).withColumn("kept", F.filter(F.flatten("pages"), lambda s: s != ""))
    d = d.select(
        "doc_id",
        "text",
        F.size("pages").cast("long").alias("pages"),
        F.size("kept").cast("long").alias("blocks"),
        F.aggregate("kept", F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("chars"),
        "body",
    )
    front = front_matter({"format": F.lit(FORMAT), "generator": F.lit("inkfold"), "source": F.lit("document"), "provider": F.lit("plain-text"), "doc_id": F.col("doc_id"), **{k: F.col(k) for k in ("pages", "blocks", "chars")}})
    md = F.concat(front, F.rtrim(F.col("body"), F.lit(" \t\n\x0b\f\r")), F.lit("\n"))
    d = d.withColumn("markdown", md)
    return d.select("doc_id", "pages", "blocks", "chars", "markdown", F.sha2("markdown", 256).alias("sha256_markdown"), F.sha2("text", 256).alias("sha256_input"))


def ordered(blocks: DataFrame, spliced: DataFrame, keys: list[str]) -> DataFrame:
    """Reading order of a page: blocks (ix, y) keep theirs; items (kind, ix, y) with a height go before the first block that is
    not above them, others to the end. Adds pos (from 0). ``y`` is null without geometry; kind ranks table 0, mark 1, kv 2."""
    inf = F.lit(float("inf"))
    b = blocks.select(*keys, F.lit(3).alias("kind"), "ix", F.coalesce(F.col("y").cast("double"), inf).alias("y"))
    s = spliced.select(*keys, "kind", "ix", F.coalesce(F.col("y").cast("double"), inf).alias("y"))
    w = Window.partitionBy(*keys)
    # the first block whose running maximum reaches an item is the first that is not above it
    b = b.withColumn("_k", F.row_number().over(w.orderBy("ix")) - 1).withColumn("_top", F.max("y").over(w.orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)))
    both = b.withColumn("_b", F.lit(1)).unionByName(s.withColumns({"_k": F.lit(None).cast("int"), "_top": F.col("y"), "_b": F.lit(0)}))
    # by running maximum: items before blocks at the same height, items without one after all blocks
    late = (F.col("_b") == 0) & (F.col("y") == inf)
    walk = w.orderBy("_top", "_b", F.col("_k").asc_nulls_first()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumn("_slot", F.when(F.col("_b") == 1, F.col("_k")).when(late, F.lit(2**31 - 1)).otherwise(F.coalesce(F.min("_k").over(walk), F.lit(2**31 - 1))))
    order = w.orderBy("_slot", "_b", F.when(F.col("_b") == 0, F.col("y")), "kind", "ix")
    return both.withColumn("pos", F.row_number().over(order) - 1).select(*keys, "kind", "ix", "pos")


def grid(cells: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Cells (row, col, text) as one markdown table for each key: dense, the last writer of a place wins, row 0 the header. Where sizes
    (keys, rows, cols) are stated, cells beyond them are dropped."""
    if sizes is not None:
        cells = cells.join(sizes, keys).where((F.col("row") < F.col("rows")) & (F.col("col") < F.col("cols")))
    last = cells.groupBy(*keys, "row", "col").agg(F.max_by("text", "ix").alias("text"), *([F.first(c).alias(f"_{c}") for c in ("rows", "cols")] if sizes is not None else []))
    size = F.col("cols")
    reach = lambda stated, at: F.first(stated) if sizes is not None else F.max(at) + 1
    g = last.groupBy(*keys).agg(reach("_rows", "row").alias("rows"), reach("_cols", "col").alias("cols"), F.map_from_entries(F.collect_list(F.struct((F.col("row") * 100_000 + F.col("col")).alias("k"), T.cell(F.col("text")).alias("v")))).alias("m"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda c: F.coalesce(F.try_element_at("m", (r * 100_000 + c).cast("long")), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), size.cast("int")))
    body = F.when(F.col("rows") > 1, F.concat(F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("rows") - 1), line), "\n"))).otherwise("")
    return g.select(*keys, F.concat(line(F.lit(0)), F.lit("\n"), rule, body).alias("markdown"), "rows", "cols")


def page_scale(unit: Column) -> Column:
    """Inches are written in thousandths, other units as they are."""
    return F.when(unit == "inch", 1000).otherwise(1)


def _hull(a: Column, b: Column) -> Column:
    """The rectangle around two, either of which may be null."""
    edge = lambda f, n: f(*(F.coalesce(x[n], y[n]) for x, y in ((a, b), (b, a)))).alias(n)
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(edge(F.least, "x0"), edge(F.least, "y0"), edge(F.greatest, "x1"), edge(F.greatest, "y1")))


def view_elements(pages: DataFrame, blocks: DataFrame, tables: DataFrame, marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, page, kind, ix, y, anchor, md) of all that is written of a recognised layout: blocks outside tables, tables, marks and
    key-value pairs (kinds 3, 0, 1, 2); anchors are null without a rectangle, elements without text are left out."""
    scale = pages.select("doc_id", "page", page_scale(F.col("unit")).alias("_scale"))

    def out(rows: DataFrame, kind: int, ix: str, rect: Column, tag: Column, md: Column) -> DataFrame:
        r = rows.join(scale, ["doc_id", "page"], "left").withColumn("_scale", F.coalesce("_scale", F.lit(1)))
        r = r.withColumns({"_r": rect, "_tag": tag, "md": md}).where("md <> ''")
        a = T.anchor(F.col("page"), *(F.col(f"_r.{n}") for n in ("x0", "y0", "x1", "y1")), F.col("_tag"))
        return r.select("doc_id", "page", F.lit(kind).alias("kind"), F.col(ix).cast("int").alias("ix"), F.col("_r.y0").cast("double").alias("y"), a.alias("anchor"), "md")

    box = lambda q: G.rect(F.col(q), F.col("_scale"))
    zone, role = F.col("zone"), F.nullif(F.col("role"), F.lit(""))
    named = zone.isin("title", "heading")
    tag = F.when(named, zone).when(zone == "furniture", F.concat_ws(":", F.lit("furniture"), role)).otherwise(F.coalesce(role, F.lit("p")))
    text = F.when(named, T.heading(F.col("text"), zone == "title")).otherwise(T.clean(F.col("text")))
    written_blocks = out(blocks.where(zone != "table"), 3, "block_ix", box("quad"), tag, text)
    cells = tables.select("doc_id", "table_ix", F.posexplode("cells").alias("ix", "c")).select("doc_id", "table_ix", "ix", "c.row", "c.col", "c.text")
    sizes = tables.select("doc_id", "table_ix", F.col("row_count").alias("rows"), F.col("col_count").alias("cols"))
    md = grid(cells, ["doc_id", "table_ix"], sizes).select("doc_id", "table_ix", F.col("markdown").alias("_md"))
    size = F.concat(F.lit("table "), F.col("row_count").cast("string"), F.lit("x"), F.col("col_count").cast("string"))
    t = out(tables.join(md, ["doc_id", "table_ix"]), 0, "table_ix", box("quad"), size, F.col("_md"))
    m = out(marks, 1, "mark_ix", box("quad"), F.lit("mark"), F.when(F.col("state") == "selected", "- [x]").otherwise("- [ ]"))
    said = T.rstrip(F.concat(F.lit("**"), T.clean(F.col("key")), F.lit(":** "), T.clean(F.col("value"))))
    k = out(pairs, 2, "kv_ix", _hull(box("key_quad"), box("value_quad")), F.lit("kv"), said)
    return written_blocks.unionByName(t).unionByName(m).unionByName(k)


def view_markdown(pages: DataFrame, blocks: DataFrame, tables: DataFrame, marks: DataFrame, pairs: DataFrame, provider: str) -> DataFrame:
    """(doc_id, pages, markdown) of recognised layouts: page by page the blocks in the provider's order, the others before the first
    block that is not above them, each under its anchor, behind a front matter with the counts."""
    e = written(view_elements(pages, blocks, tables, marks, pairs), "elements")
    keys = ["doc_id", "page"]
    pos = ordered(e.where("kind = 3").select(*keys, "ix", "y"), e.where("kind < 3").select(*keys, "kind", "ix", "y"), keys)
    part = F.concat_ws("\n", "anchor", "md")
    body = e.join(pos, [*keys, "kind", "ix"]).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    every = pages.select(*keys)
    for d in (blocks, tables, marks, pairs):
        every = every.unionByName(d.select(*keys))
    info = pages.groupBy(*keys).agg(F.min(F.struct("width", "height", "unit")).alias("i"))
    p = every.distinct().join(info, keys, "left").join(body, keys, "left")
    scale = F.coalesce(page_scale(F.col("i.unit")), F.lit(1))
    mark = T.page_marker(F.col("page"), F.col("i.width") * scale, F.col("i.height") * scale, F.col("i.unit"), scale)
    p = p.withColumn("text", F.concat_ws("\n\n", F.coalesce(mark, T.page_marker(F.col("page"))), "body"))
    docs = p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    many = lambda d, name: d.groupBy("doc_id").agg(F.count("*").alias(name))
    docs = docs.join(blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars")), "doc_id", "left")
    for d, name in ((tables, "tables"), (marks, "marks"), (pairs, "key_values")):
        docs = docs.join(many(d, name), "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    front = front_matter({"format": F.lit(FORMAT), "generator": F.lit("inkfold"), "source": F.lit("layout"), "provider": F.lit(provider), "doc_id": F.col("doc_id"), "pages": F.col("pages"), **{k: n(k) for k in ("blocks", "tables", "marks", "key_values", "chars")}})
    return docs.select("doc_id", "pages", F.concat(front, T.rstrip(F.col("text")), F.lit("\n")).alias("markdown"))
