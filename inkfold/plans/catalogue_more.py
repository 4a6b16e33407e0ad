"""Queries over provider layouts, canvases, trees as markdown, patches and verdicts in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bands, canvas, patch, trees
from ..session import written
from ..sources import provider, texts
from . import catalogue_layout as L
from .catalogue_text import _BLOCKS, _HTML, html_blocks, table


def _read_json(spark, sf) -> DataFrame:
    """Documents as recognised pages: a line result for each line of text."""
    d = table(spark, sf, "documents")
    line = lambda t, i: F.struct(t.alias("text"), F.array(*(x.cast("double") for x in (F.lit(72), 12 * i, 72 + 6 * F.length(t), 12 * i, 72 + 6 * F.length(t), 12 * i + 10, F.lit(72), 12 * i + 10))).alias("boundingBox"))
    page = F.struct(F.lit(1).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.col("lang").alias("language"), F.transform(F.split("text", "\n"), line).alias("lines"))
    return d.select("doc_id", F.to_json(F.struct(F.struct(F.lit("3.2").alias("version"), F.array(page).alias("readResults")).alias("analyzeResult"))).alias("json"))


def provider_read(spark, sf):
    """Blocks of line results: every line that is not blank, in the body zone."""
    b = provider.blocks(provider.parsed(_read_json(spark, sf)))
    return b.select("doc_id", "block_ix", "page", "text", "zone")


def provider_languages(spark, sf):
    return provider.languages(provider.parsed(_read_json(spark, sf))).select("doc_id", F.array_join("languages", ",").alias("languages"))


def _layout_json(spark, sf, more=lambda d: []) -> DataFrame:
    """Documents as layouts: paragraphs with roles and spans, lines of 78 characters, a table over every line with a pipe; and more."""
    d = table(spark, sf, "documents").withColumn("p", F.split("text", "\n"))
    offs = F.aggregate("p", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
    d = d.withColumn("po", F.arrays_zip("p", F.slice(offs, 1, F.size("p")).alias("o")))  # beside the lines: within a transform they would be summed anew for each line
    span = lambda off, n: F.array(F.struct(off.alias("offset"), n.cast("long").alias("length")))
    para = F.transform("po", lambda x, i: F.struct(x["p"].alias("content"), F.when(i == 0, "title").when(i % 5 == 4, "sectionHeading").alias("role"), span(x["o"], F.length(x["p"])).alias("spans")))
    d = d.withColumn("paragraphs", para).withColumn("n", F.size("p"))
    tables = F.transform(F.filter("paragraphs", lambda x: x["content"].contains("|")), lambda x: F.struct(x["spans"].alias("spans"), F.array(F.struct(F.lit(0).alias("rowIndex"), F.lit(0).alias("columnIndex"), x["content"].alias("content"))).alias("cells")))
    pieces = lambda t: F.regexp_extract_all(t, F.lit("(?s).{1,78}"), F.lit(0))  # noqa: E731 - in one pass: a substring counts its characters from the text's start
    cuts = F.flatten(F.transform("paragraphs", lambda x: F.transform(pieces(x["content"]), lambda t, i: F.struct(t.alias("content"), span(x["spans"][0]["offset"] + i * 78, F.length(t)).alias("spans")))))
    page = F.struct(F.lit(1).alias("pageNumber"), F.lit(8.5).alias("width"), F.lit(11.0).alias("height"), F.lit("inch").alias("unit"), cuts.alias("lines"))
    return d.select("doc_id", F.to_json(F.struct(F.array(page).alias("pages"), "paragraphs", tables.alias("tables"), *more(d))).alias("json"))


def read_layouts(spark, sf, more=lambda d: [], lists: dict[str, str] = provider.LISTS) -> DataFrame:
    """Parsed layouts, written once: a filter on what is parsed would be pushed below the parsing and the making of the JSON, and work
    out both again for each field of it. The JSON itself is not written, of the layouts what is in the lists named."""
    return written(provider.parsed(_layout_json(spark, sf, more), lists=lists).drop("json"), "layouts")


def provider_layout(spark, sf):
    """Zones of a layout's paragraphs: by role, else table where a table's span covers them, else body."""
    b = provider.blocks(read_layouts(spark, sf))
    return b.select("doc_id", "block_ix", "zone", F.length("text").cast("long").alias("chars"))


def provider_lines(spark, sf):
    """Lines of layouts attached to their blocks, for each document and block."""
    a = provider.attached_lines(read_layouts(spark, sf))
    return a.groupBy("doc_id", "block_ix").agg(F.count("*").alias("lines"))


_LAYOUT = """parts AS (SELECT doc_id, i, s, CASE WHEN i = 0 THEN 'title' WHEN i % 5 = 4 THEN 'heading' WHEN contains(s, '|') THEN 'table' ELSE 'body' END AS zone
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(s) <> ''),
nb AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS block_ix FROM parts)"""


def canvas_rows(spark, sf):
    """Rows of the canvases of two-column pages."""
    a, em, b = L._banded(spark, sf)
    f = bands.frames(b, bands.gutters(bands.occupancy(b, em, L.PAGE), L.PAGE), em, L.PAGE)
    return canvas.rows(bands.tab_stops(b, f, L.PAGE), b, f, em, L.PAGE).select("page", "band", F.col("row").cast("long").alias("row"), "text")


def canvas_segments(spark, sf):
    a, em, b = L._banded(spark, sf)
    f = bands.frames(b, bands.gutters(bands.occupancy(b, em, L.PAGE), L.PAGE), em, L.PAGE)
    s = canvas.segments(canvas.rows(bands.tab_stops(b, f, L.PAGE), b, f, em, L.PAGE), L.PAGE)
    return s.select("page", "segment", "row_lo", "row_hi", F.sha2("canvas", 256).alias("sha256"))


def tree_markdown(spark, sf):
    """Pages as trees: blocks under their headings, as many hashes as they are deep, five at most; one text a page."""
    b = html_blocks(spark, sf)
    level = F.when(F.col("zone") == "title", 1).when(F.col("zone") == "heading", 2)
    n = trees.heading_parents(b.select("page_id", F.col("seq").alias("ix"), level.alias("level"), "text", "zone"), ["page_id"])
    t = T.clean(F.col("text"))
    safe = F.when(t.startswith("#"), F.concat(F.lit("\\"), t)).otherwise(t)
    depth = F.when(F.col("parent_ix").isNull(), 1).otherwise(2)
    md = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), 1 + F.least(F.greatest(depth, F.lit(1)), F.lit(5))), F.lit(" "), safe)).otherwise(t)
    g = n.select("page_id", "ix", md.alias("md")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "md"))), lambda x: x["md"]), "\n\n").alias("body"))
    return g.select("page_id", F.sha2("body", 256).alias("sha256_markdown"))


def _region_trees(spark, sf) -> DataFrame:
    """A small tree for each region: the body, a heading for each nation, a paragraph for each of its first customers."""
    n = table(spark, sf, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    head = n.withColumn("k", F.row_number().over(w)).select(F.col("n_regionkey").cast("long").alias("doc_id"), (F.col("k") * 10).cast("long").alias("id"), F.lit(1).cast("long").alias("parent"), F.lit("heading").alias("kind"), "n_nationkey")
    kids = head.select("doc_id", "id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("j")).select("doc_id", (F.col("id") + F.col("j")).alias("id"), F.col("id").alias("parent"), F.lit("paragraph").alias("kind"))
    top = n.select(F.col("n_regionkey").cast("long").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit("doc").alias("kind")), F.struct(F.lit(1).cast("long").alias("id"), F.lit(0).cast("long").alias("parent"), F.lit("body").alias("kind")))).alias("x")).select("doc_id", "x.*")
    return top.unionByName(head.drop("n_nationkey")).unionByName(kids)


def patch_apply(spark, sf):
    """Each region's first nation's first paragraph moves to its second nation; in odd regions the patch names a path that is not there."""
    t = _region_trees(spark, sf)
    d = t.select("doc_id").distinct()
    ops = d.select("doc_id", F.lit(0).cast("long").alias("op_ix"), F.lit("reparent").alias("op"), F.lit("//doc/body[1]/h[1]/p[1]").alias("node"), F.when(F.col("doc_id") % 2 == 0, "//doc/body[1]/h[2]").otherwise("//doc/body[1]/h[99]").alias("ref"))
    return patch.apply_patches(t, ops)


def verify_stateful(spark, sf):
    """Two moves: the second is judged on the tree that the first left."""
    t = _region_trees(spark, sf).withColumn("page", F.lit(1))
    d = t.select("doc_id").distinct()
    ops = d.select("doc_id", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("op_ix"), F.lit(op).alias("op"), F.lit(n).cast("long").alias("node"), F.lit(r).cast("long").alias("ref")) for i, (op, n, r) in enumerate([("reparent", 10, 20), ("reparent", 20, 10), ("move_after", 21, 11), ("merge_flow", 22, 12), ("move_before", 1, 21), ("move_before", 999, 21)])))).alias("o")).select("doc_id", "o.*")
    return patch.judge(t, ops)


def block_widths(spark, sf):
    """Display cells and direction of every block."""
    b = texts.text_blocks(table(spark, sf, "documents"))
    return b.select("doc_id", "block_ix", T.cell_width(F.col("text")).alias("cells"), T.is_rtl(F.col("text")).alias("rtl"), T.norm(F.col("text")).alias("norm"))


def section_conflicts(spark, sf):
    """Event types as sections of a page for each user, hours as bands, three columns."""
    e = table(spark, sf, "events")
    leaf = e.select((F.col("user_id") % 20).alias("doc"), F.col("user_id").alias("page"), F.ascii("event_type").alias("section"), F.hour(F.col("ts").cast("timestamp")).alias("band"), (F.col("event_id") % 3 * 100).alias("col_x0"), (F.col("event_id") % 3 * 100 + 60 + F.col("event_id") % 2 * 70).alias("col_x1"))
    return trees.conflicts(leaf, ["doc"])


def furniture(spark, sf):
    """Line items as running heads and feet of their order."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    role = F.element_at(F.array(*(F.lit(x) for x in ("pageFooter", "pageNumber", "pageHeader", "other"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    b = l.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), role.alias("role"), F.when(F.col("l_linenumber") % 2 == 0, F.col("q")).alias("y0"), F.lit(None).cast("double").alias("x0"), F.col("l_linenumber").alias("block_ix"))
    return trees.furniture_order(b, ["doc_id"]).select("doc_id", "role", "block_ix", "pos")


def review_reasons(spark, sf):
    """Orders as trees: their line items give bands, frames, ties and nodes."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("band"), F.sum("l_quantity").alias("q"))
    r = trees.review_reason(F.col("n") > 1, F.when(F.col("q") > 150, 2).otherwise(1), F.when(F.col("l_orderkey") % 11 == 0, 1).otherwise(0), F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0), F.when(F.col("l_orderkey") % 2 == 0, "absent").otherwise("present"), F.col("band"), F.col("n") * 3)
    l = l.withColumn("reason", r)
    return l.select("l_orderkey", "reason", trees.deserves_review(F.col("reason")).alias("review"))


_FUNCS = (section_conflicts, furniture, review_reasons, provider_read, provider_languages, provider_layout, provider_lines, canvas_rows, canvas_segments, tree_markdown, patch_apply, verify_stateful, block_widths)
QUERIES = {f.__name__: f for f in _FUNCS}

_CANVAS = f"""{L._TWO}, starts AS (SELECT page, frame_ix, coalesce(sum(cells + 3) OVER (PARTITION BY page ORDER BY frame_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col_start FROM cells),
placed AS (SELECT h.page, h.row, h.frame_ix, h.text, s.col_start + mode((h.x0 - a.fx0) // a.adv) OVER (PARTITION BY h.page, h.frame_ix) AS pos FROM homed h JOIN adv a USING (page, frame_ix) JOIN starts s USING (page, frame_ix)),
both_ AS (SELECT page, row, max(text) FILTER (frame_ix = 0) AS l, max(text) FILTER (frame_ix = 1) AS r, max(pos) FILTER (frame_ix = 0) AS la, max(pos) FILTER (frame_ix = 1) AS ra FROM placed GROUP BY 1, 2),
canvas AS (SELECT page, row, coalesce(repeat(' ', CAST(la AS INTEGER)) || l, '') || CASE WHEN r IS NULL THEN '' ELSE repeat(' ', CAST(greatest(ra - coalesce(la + length(l), 0), CASE WHEN l IS NULL THEN 0 ELSE 1 END) AS INTEGER)) || r END AS text FROM both_)"""
SQL = {
    "section_conflicts": """WITH l AS (SELECT user_id % 20 AS doc, user_id AS page, ascii(event_type) AS section, hour(ts) AS band, event_id % 3 * 100 AS x0, event_id % 3 * 100 + 60 + event_id % 2 * 70 AS x1 FROM events),
s AS (SELECT doc, page, section, min(band) AS lo, max(band) AS hi FROM l GROUP BY ALL), c AS (SELECT DISTINCT doc, page, section, x0, x1 FROM l)
SELECT a.doc, a.page, a.section AS a_section, b.section AS b_section FROM s a JOIN s b ON a.doc = b.doc AND a.page = b.page AND a.section < b.section
WHERE EXISTS (SELECT 1 FROM c x JOIN c y ON x.doc = a.doc AND x.page = a.page AND x.section = a.section AND y.doc = b.doc AND y.page = b.page AND y.section = b.section
    WHERE 2 * (least(x.x1, y.x1) - greatest(x.x0, y.x0)) > x.x1 - x.x0 AND 2 * (least(x.x1, y.x1) - greatest(x.x0, y.x0)) > y.x1 - y.x0)
  AND (a.lo > b.lo OR (least(a.hi, b.hi) >= greatest(a.lo, b.lo) AND 3 * (least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) > least(a.hi - a.lo, b.hi - b.lo) + 1))""",
    "furniture": """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS block_ix, ['pageFooter', 'pageNumber', 'pageHeader', 'other'][l_linenumber % 4 + 1] AS role, CASE WHEN l_linenumber % 2 = 0 THEN max(l_quantity) ELSE 0 END AS y FROM lineitem GROUP BY 1, 2)
SELECT doc_id, role, block_ix, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['pageHeader', 'pageNumber', 'pageFooter', 'other'], role), y, block_ix) - 1 AS INTEGER) AS pos FROM b""",
    "review_reasons": """WITH t AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, CASE WHEN n <= 1 THEN 'no_geometry' WHEN q > 150 THEN 'multi_frame' WHEN l_orderkey % 11 = 0 THEN 'coverage_fallback' WHEN l_orderkey % 5 = 0 THEN 'order_ties' WHEN l_orderkey % 2 = 0 AND n * 3 > 10 THEN 'sectionless_multiband' ELSE 'clean_single_column' END AS reason FROM t)
SELECT l_orderkey, reason, reason NOT IN ('no_geometry', 'clean_single_column') AS review FROM r""",
    "provider_read": f"WITH {_BLOCKS} SELECT doc_id, block_ix, 1 AS page, text, 'body' AS zone FROM blocks",
    "provider_languages": "SELECT doc_id, lang AS languages FROM documents",
    "provider_layout": f"WITH {_LAYOUT} SELECT doc_id, block_ix, zone, CAST(length(trim(s)) AS BIGINT) AS chars FROM nb",
    "provider_lines": f"WITH {_LAYOUT} SELECT doc_id, block_ix, CAST((length(s) - 1) // 78 + 1 AS BIGINT) AS lines FROM nb WHERE zone <> 'table'",
    "canvas_rows": f"WITH {_CANVAS} SELECT page, CAST(dense_rank() OVER (PARTITION BY page ORDER BY row) - 1 AS INTEGER) AS band, row - min(row) OVER (PARTITION BY page) AS row, text FROM canvas",
    "tree_markdown": f"""{_HTML}, n AS (SELECT *, CASE zone WHEN 'title' THEN 1 WHEN 'heading' THEN 2 END AS level FROM blocks),
p AS (SELECT a.page_id, a.seq, a.text, a.level, CASE WHEN a.level IS NOT NULL AND EXISTS (SELECT 1 FROM n b WHERE b.page_id = a.page_id AND b.seq < a.seq AND b.level < a.level) THEN '### ' WHEN a.level IS NOT NULL THEN '## ' ELSE '' END AS hash FROM n a)
SELECT page_id, sha256(string_agg(hash || CASE WHEN level IS NOT NULL AND text LIKE '#%' THEN chr(92) ELSE '' END || text, chr(10) || chr(10) ORDER BY seq)) AS sha256_markdown FROM p GROUP BY 1""",
    "canvas_segments": f"""WITH RECURSIVE {_CANVAS}, c AS (SELECT page, row - min(row) OVER (PARTITION BY page) AS row, text, row_number() OVER (PARTITION BY page ORDER BY row) AS k FROM canvas),
s AS (SELECT page, k, row AS lo, row AS hi, length(text) + 1 AS n, 0 AS segment, text FROM c WHERE k = 1
  UNION ALL SELECT page, k, CASE WHEN fits THEN lo ELSE row END, row, CASE WHEN fits THEN grown ELSE length(text) + 1 END, segment + (NOT fits)::INT, CASE WHEN fits THEN repeat(chr(10), CAST(row - hi - 1 AS INTEGER)) ELSE '' END || text FROM (
    SELECT c.page, c.k, c.row, c.text, s.lo, s.hi, s.segment, s.n + length(c.text) + 1 + (c.row - s.hi - 1) AS grown, c.row - s.lo + 1 <= 20 AND s.n + length(c.text) + 1 + (c.row - s.hi - 1) <= 1400 AS fits FROM s JOIN c ON c.page = s.page AND c.k = s.k + 1))
SELECT page, CAST(segment AS INTEGER) AS segment, min(lo) AS row_lo, max(hi) AS row_hi, sha256(string_agg(text, chr(10) ORDER BY k)) AS sha256 FROM s GROUP BY 1, 2""",
    "patch_apply": """WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS d, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation),
h AS (SELECT d, k, 0 AS j, k * 10 AS old FROM n), p AS (SELECT d, k, unnest([1, 2, 3]) AS j FROM n),
moved AS (SELECT d, CASE WHEN d % 2 = 0 AND k = 1 AND j = 1 THEN 2 ELSE k END AS k, CASE WHEN d % 2 = 0 AND k = 1 AND j = 1 THEN 9 ELSE j END AS j, k * 10 + j AS old FROM p),
items AS (SELECT DISTINCT d, -1 AS k, 0 AS j, 0 AS old FROM n UNION ALL SELECT DISTINCT d, 0, 0, 1 FROM n UNION ALL SELECT * FROM h UNION ALL SELECT * FROM moved),
ids AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k, j) - 1 AS id, row_number() OVER (PARTITION BY d, k ORDER BY j) - 1 AS nth FROM items)
SELECT a.d AS doc_id, CAST(a.old AS BIGINT) AS old_id, a.id, CASE WHEN a.k = -1 THEN NULL WHEN a.k = 0 THEN 0 WHEN a.j = 0 THEN 1 ELSE (SELECT id FROM ids b WHERE b.d = a.d AND b.k = a.k AND b.j = 0) END AS parent,
  CASE WHEN a.k = -1 THEN '//doc' WHEN a.k = 0 THEN '//doc/body[1]' WHEN a.j = 0 THEN '//doc/body[1]/h[' || a.k || ']' ELSE '//doc/body[1]/h[' || a.k || ']/p[' || a.nth || ']' END AS path, CASE WHEN a.d % 2 = 0 THEN 'ok' ELSE '0:unknown_path' END AS status FROM ids a""",
    "block_widths": f"""WITH {_BLOCKS} SELECT doc_id, block_ix, CAST(length(regexp_replace(text, '[\\p{{Mn}}\\p{{Me}}\\p{{Cf}}]', '', 'g')) + length(regexp_replace(text, '[^\\x{{1100}}-\\x{{115f}}\\x{{2e80}}-\\x{{303e}}\\x{{3041}}-\\x{{a4cf}}\\x{{ac00}}-\\x{{d7a3}}\\x{{f900}}-\\x{{faff}}\\x{{fe30}}-\\x{{fe6f}}\\x{{ff00}}-\\x{{ff60}}\\x{{ffe0}}-\\x{{ffe6}}\\x{{1f300}}-\\x{{1f64f}}\\x{{1f900}}-\\x{{1f9ff}}\\x{{20000}}-\\x{{3fffd}}]', '', 'g')) AS BIGINT) AS cells,
  2 * length(regexp_replace(text, '[^\\x{{590}}-\\x{{8ff}}\\x{{fb1d}}-\\x{{fdff}}\\x{{fe70}}-\\x{{feff}}]', '', 'g')) > length(regexp_replace(text, '[^\\p{{L}}\\x{{590}}-\\x{{8ff}}\\x{{fb1d}}-\\x{{fdff}}\\x{{fe70}}-\\x{{feff}}]', '', 'g')) AS rtl, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM blocks""",
    "verify_stateful": "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(i AS BIGINT) AS op_ix, v AS verdict FROM region, (VALUES (0, 'ACCEPT'), (1, 'REJECT_ORPHAN'), (2, 'ACCEPT'), (3, 'ACCEPT'), (4, 'REJECT_ORPHAN'), (5, 'REJECT_UNKNOWN_ID')) t(i, v)",
}
