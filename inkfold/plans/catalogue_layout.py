"""Queries over geometry, joins, trees and votes, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import bands, emit, joins, ranks, trees, votes
from ..session import written
from ..sources import texts
from .catalogue_text import _BLOCKS, _VOID, _WRAP, _LAST, table

PAGE = ["page"]


def two_column(spark, sf) -> DataFrame:
    """Conversations as two-column pages: assistants right, all others left, every turn in lines of 36 characters."""
    c = table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 10).alias("page"), "conv_id", "turn", (F.col("role") == "assistant").cast("int").alias("side"), T.norm_ws(F.col("text")).alias("t")).where("t <> ''")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 36).cast("int")), lambda i: T.rstrip(F.substring("t", i * 36 + 1, F.lit(36))))
    c = c.select("page", "conv_id", "turn", "side", F.posexplode(cut).alias("line", "text"))
    row = F.row_number().over(Window.partitionBy("page", "side").orderBy("conv_id", "turn", "line")) - 1
    x0 = F.when(F.col("side") == 0, 72).otherwise(324)
    c = c.withColumn("row", row).withColumn("atom_ix", (F.col("row") * 2 + F.col("side")).cast("long"))
    y1 = (72 + 12 * (F.col("row") + 1)) * 1000
    return c.select("page", "atom_ix", F.lit("line").alias("kind"), "text", (x0 * 1000).cast("long").alias("x0"), (y1 - 10_000).cast("long").alias("y0"), ((x0 + 6 * F.length("text")) * 1000).cast("long").alias("x1"), y1.cast("long").alias("y1"))


_TWO = r"""turns AS (SELECT conv_id // 10 AS page, conv_id, turn, (role = 'assistant')::INT AS side, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
cut36 AS (SELECT page, conv_id, turn, side, t, unnest(range(0, (length(t) - 1) // 36 + 1)) AS line FROM turns WHERE t <> ''),
two AS (
  SELECT page, CAST(row_number() OVER (PARTITION BY page, side ORDER BY conv_id, turn, line) - 1 AS BIGINT) AS row, side, rtrim(substr(t, line * 36 + 1, 36)) AS text FROM cut36
), atoms AS (
  SELECT page, row * 2 + side AS atom_ix, row, text, (CASE side WHEN 0 THEN 72 ELSE 324 END) * 1000 AS x0, (72 + 12 * (row + 1)) * 1000 - 10000 AS y0,
         (CASE side WHEN 0 THEN 72 ELSE 324 END + 6 * length(text)) * 1000 AS x1, (72 + 12 * (row + 1)) * 1000 AS y1 FROM two
), ext AS (SELECT page, min(x0) AS cx0, max(x1) AS cx1, count(DISTINCT row) AS k FROM atoms GROUP BY page),
cover AS (SELECT DISTINCT a.page, a.row, unnest(range((a.x0 - cx0) // 2500, (a.x1 - cx0) // 2500 + 1)) AS bucket FROM atoms a JOIN ext USING (page)),
occ AS (
  SELECT e.page, e.bucket, count(c.row) AS occ, any_value(k) AS k, any_value(cx0) AS cx0, any_value(cx1) AS cx1
  FROM (SELECT page, k, cx0, cx1, unnest(range(0, (cx1 - cx0) // 2500 + 1)) AS bucket FROM ext) e LEFT JOIN cover c ON c.page = e.page AND c.bucket = e.bucket GROUP BY 1, 2
), gut AS (
  SELECT page, row_number() OVER (PARTITION BY page ORDER BY min(bucket)) - 1 AS gutter_ix, any_value(cx0) + min(bucket) * 2500 AS gx0, any_value(cx0) + (max(bucket) + 1) * 2500 AS gx1
  FROM (SELECT *, bucket - row_number() OVER (PARTITION BY page ORDER BY bucket) AS run FROM occ WHERE k >= 4 AND occ <= 3 AND k - occ >= 4)
  GROUP BY page, run HAVING min(bucket) > 0 AND max(bucket) < (any_value(cx1) - any_value(cx0)) // 2500 AND count(*) * 2500 * 2 >= 10000 * 3
), fr AS (
  SELECT page, 0 AS frame_ix, cx0 AS fx0, coalesce((SELECT min(gx0) FROM gut g WHERE g.page = e.page), cx1) AS fx1 FROM ext e
  UNION ALL SELECT g.page, g.gutter_ix + 1, g.gx1, coalesce((SELECT min(gx0) FROM gut h WHERE h.page = g.page AND h.gx0 > g.gx0), e.cx1) FROM gut g JOIN ext e USING (page)
), homed AS (
  SELECT a.*, f.frame_ix, f.fx0, f.fx1 FROM atoms a JOIN fr f USING (page)
  WHERE f.frame_ix = coalesce((SELECT min(h.frame_ix) FROM fr h WHERE h.page = a.page AND (a.x0 + a.x1) // 2 <= h.fx1), (SELECT max(h.frame_ix) FROM fr h WHERE h.page = a.page))
), adv AS (
  SELECT f.page, f.frame_ix, f.fx0, f.fx1, greatest(coalesce(m, 5000), 1) AS adv FROM fr f LEFT JOIN (
    SELECT page, frame_ix, list_sort(list((x1 - x0) // length(text)) FILTER (length(text) >= 4))[(count(*) FILTER (length(text) >= 4) - 1) // 2 + 1] AS m FROM homed GROUP BY 1, 2) USING (page, frame_ix)
), cells AS (
  SELECT a.page, a.frame_ix, a.fx0, a.fx1, a.adv, greatest((a.fx1 - a.fx0 + a.adv - 1) // a.adv, coalesce(max((h.x0 - a.fx0) // a.adv + length(h.text)), 0)) AS cells
  FROM adv a LEFT JOIN homed h USING (page, frame_ix) GROUP BY a.page, a.frame_ix, a.fx0, a.fx1, a.adv
)"""


def _banded(spark, sf):
    """Atoms, em and bands; the bands are a written table, since every step after them reads them."""
    b = written(bands.bands(two_column(spark, sf), PAGE), "bands")
    return b.drop("band"), bands.page_em(b, PAGE), b


def two_column_bands(spark, sf):
    return _banded(spark, sf)[2].select("page", "atom_ix", "band")


def occupancy(spark, sf):
    _, em, b = _banded(spark, sf)
    return bands.occupancy(b, em, PAGE).select("page", "bucket", "occ", "k")


def gutters(spark, sf):
    _, em, b = _banded(spark, sf)
    return bands.gutters(bands.occupancy(b, em, PAGE), PAGE)


def frames(spark, sf):
    _, em, b = _banded(spark, sf)
    return bands.frames(b, bands.gutters(bands.occupancy(b, em, PAGE), PAGE), em, PAGE)


def tab_stops(spark, sf):
    _, em, b = _banded(spark, sf)
    f = bands.frames(b, bands.gutters(bands.occupancy(b, em, PAGE), PAGE), em, PAGE)
    return bands.tab_stops(b, f, PAGE)


def order_ties(spark, sf):
    a, em, _ = _banded(spark, sf)
    return bands.order_ties(a, em, PAGE, ["atom_ix"])


def _rows(spark, sf):
    return texts.row_rects(texts.wrap_pages(table(spark, sf, "documents")))


def _row_atoms(spark, sf):
    m = lambda c: (F.col(c) * 1000).alias(c)
    return _rows(spark, sf).select("doc_id", "page", F.col("row").alias("atom_ix"), F.lit("line").alias("kind"), "text", m("x0"), m("y0"), m("x1"), m("y1"))


def separators(spark, sf):
    k = ["doc_id", "page"]
    return bands.separators(bands.bands(_row_atoms(spark, sf), k), k)


def bbox_union(spark, sf):
    """Hulls of pages and of documents in one pass."""
    r = _rows(spark, sf).groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return r


def page_em(spark, sf):
    return bands.page_em(_row_atoms(spark, sf), ["doc_id", "page"])


def page_gates(spark, sf):
    """Laid out, or why not; documents divisible by seven state no page size."""
    k = ["doc_id", "page"]
    p = texts.wrap_pages(table(spark, sf, "documents")).select(*k).distinct().withColumns({"width": F.when(F.col("doc_id") % 7 == 0, 0).otherwise(612), "height": F.lit(792)})
    return bands.page_gate(_row_atoms(spark, sf), p, k)


def rect_round_modes(spark, sf):
    """Both roundings of coordinates made of prices and quantities."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.col("l_discount") * 50).alias("v"))
    return l.select("l_orderkey", "l_linenumber", G.scaled(F.col("v"), 1).alias("even"), G.scaled(F.col("v"), 1000).alias("half_up"), G.mu_to_scale(G.mu(F.col("v")), 1).alias("back"))


_K = "l_quantity + l_discount * 50"


def _spans(spark, sf):
    """Newline paragraphs and their 78-character cuts, as spans over the same text."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_ix", "s"))
    before = Window.partitionBy("doc_id").orderBy("block_ix").rowsBetween(Window.unboundedPreceding, -1)
    b = d.select("doc_id", "block_ix", F.coalesce(F.sum(F.length("s") + 1).over(before), F.lit(0)).cast("long").alias("off"), F.length("s").cast("long").alias("len"))
    b = b.where("len > 0")
    starts = b.select("doc_id", "off", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / 78))).alias("i"))
    lines = starts.select("doc_id", (F.col("off") + F.col("i") * 78).alias("off"), F.least(F.lit(78).cast("long"), F.col("len") - F.col("i") * 78).alias("len"))
    w = Window.partitionBy("doc_id").orderBy("off")
    return lines.withColumn("line_ix", F.row_number().over(w) - 1), b


def span_join(spark, sf):
    lines, b = _spans(spark, sf)
    return joins.span_join(lines, b)


def line_join_health(spark, sf):
    """Lines claimed and lines in all, for each document."""
    lines, b = _spans(spark, sf)
    n = lines.groupBy("doc_id").agg(F.count("*").alias("total"))
    got = joins.span_join(lines, b).groupBy("doc_id").agg(F.count("*").alias("attached"))
    return n.join(got, "doc_id", "left").select("doc_id", F.coalesce("attached", F.lit(0).cast("long")).alias("attached"), "total")


_SPANS = """paras AS (
  SELECT doc_id, i AS block_ix, s, CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, length(s) AS len
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS i FROM documents)
), cuts AS (
  SELECT doc_id, block_ix, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_ix, j) - 1 AS INTEGER) AS line_ix FROM (SELECT doc_id, block_ix, unnest(range(0, (len - 1) // 78 + 1)) AS j FROM paras WHERE len > 0)
)"""


def table_zone_semi(spark, sf):
    """Cuts that overlap a line with a pipe, read as a table."""
    lines, b = _spans(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_ix", "s")).where(F.col("s").contains("|"))
    tables = b.join(d, ["doc_id", "block_ix"]).select("doc_id", "off", "len")
    return joins.overlap_semi(lines, tables, ["doc_id"]).select("doc_id", "line_ix")


def coverage_gate(spark, sf):
    """Whether the rows of each document say all of its text, white space aside."""
    d = table(spark, sf, "documents")
    r = texts.wrap_pages(d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "row", "text"))), lambda x: x["text"]), "").alias("joined"))
    bare = lambda c: F.regexp_replace(c, f"[{T.WS}]+", "")
    return d.join(r, "doc_id").select("doc_id", (bare(F.col("text")) == bare(F.col("joined"))).alias("covered"))


def _kv(spark, sf):
    e = table(spark, sf, "events")
    y = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("user_id").alias("page"), F.col("event_type").alias("key"), y.alias("y0"), (y + 1).alias("y1"))


def kv_gap_clusters(spark, sf):
    """Pairs of a page in clusters: a gap of more than an hour starts the next."""
    c = joins.gap_clusters(_kv(spark, sf), PAGE, "y0", "y1", F.lit(3600), ["event_id"])
    return c.groupBy("page", "cluster").agg(F.count("*").alias("pairs"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def kv_containment(spark, sf):
    """The first region of its hour that holds a pair wholly, and the first that holds its centre."""
    e = _kv(spark, sf).withColumn("hour", F.floor(F.col("y0") / 3600))
    r = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("region_ix"), (F.col("hour") * 3600 + i * 900).alias("ry0"), (F.col("hour") * 3600 + i * 900 + 900 - i * 10).alias("ry1"))))
    regions = e.select("hour").distinct().select("hour", r.alias("r")).select("hour", "r.*")
    centre = G.floordiv(F.col("y0") + F.col("y1"), 2)
    j = e.join(regions, "hour").groupBy("event_id").agg(
        F.min(F.when((F.col("y0") >= F.col("ry0")) & (F.col("y1") <= F.col("ry1")), F.col("region_ix"))).alias("whole_ix"),
        F.min(F.when((centre >= F.col("ry0")) & (centre <= F.col("ry1")), F.col("region_ix"))).alias("centre_ix"),
    )
    return j


def continuity_edges(spark, sf):
    """Blocks of a document that go on in the next: score and evidence; equal heights and widths are taken as given."""
    d = table(spark, sf, "documents")
    u, c = T.case_counts(F.col("text"))
    b = d.withColumn("voided", T.case_voided(u, c)).select("doc_id", "voided", F.posexplode(texts.blocks_of(F.col("text"))).alias("block_ix", "text"))
    b = b.withColumn("mark", T.last_mark(F.col("text")))
    b = b.select("doc_id", "block_ix", T.is_hyphen(F.col("mark")).alias("h"), T.is_terminal(F.col("mark")).alias("e"), T.starts_lowercase(F.col("text"), F.col("voided")).alias("s"))
    w = Window.partitionBy("doc_id").orderBy("block_ix")
    b = b.withColumns({"dst_ix": F.lead("block_ix").over(w), "s": F.lead("s").over(w)}).where("dst_ix IS NOT NULL")
    k = trees.continuation(F.col("h"), F.col("e"), F.col("s"), F.lit(True), F.lit(False), F.lit(True))
    return b.select("doc_id", F.col("block_ix").alias("src_ix"), "dst_ix", k.alias("k")).select("doc_id", "src_ix", "dst_ix", F.col("k.score").alias("score"), F.col("k.evidence").alias("evidence")).where(F.col("score") >= trees.CONFIRM_LEAST)


def heading_nesting(spark, sf):
    """Lines of documents as headings by their length, nested."""
    b = texts.text_blocks(table(spark, sf, "documents"))
    n = F.length("text")
    level = F.when(n < 40, 1).when(n < 60, 2).when(n < 70, 3).when(n < 80, 4)
    return trees.heading_parents(b.select("doc_id", F.col("block_ix").alias("ix"), level.alias("level")), ["doc_id"])


def _nodes(spark, sf):
    n = table(spark, sf, "nation")
    root = spark.createDataFrame([("doc", None, "doc", 0)], "id string, parent string, kind string, pos long")
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("doc").alias("parent"), F.lit("sect").alias("kind"), F.col("r_regionkey").cast("long").alias("pos"))
    s = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit("sect").alias("kind"), F.col("n_nationkey").cast("long").alias("pos"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 5 == 0, "h").otherwise("p").alias("kind"), F.col("c_custkey").alias("pos"))
    return root.unionByName(r).unionByName(s).unionByName(c)


def tree_paths(spark, sf):
    return trees.sibling_paths(_nodes(spark, sf), 3).select("id", "path")


def tree_preorder(spark, sf):
    """Pre-order ids: the places of all nodes in the order of their sibling places."""
    return ranks.ranked(trees.sibling_paths(_nodes(spark, sf), 3).select("id", "order"), ["order"], "pre_id").select("id", "pre_id")


def tree_validate(spark, sf):
    """Documents that labels do not claim just once."""
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return joins.claims_exact(d, l.union(l.where("doc_id % 10 = 0")), ["doc_id"])


def fallback_unclaimed(spark, sf):
    return joins.unclaimed(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "lang")


def body_merge(spark, sf):
    """Claimed documents by tier 0, the rest by tier 3, in one order within each language."""
    d, l = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", F.lit(0).alias("tier"))
    j = d.join(l, "doc_id", "left").withColumn("tier", F.coalesce("tier", F.lit(3)))
    r = ranks.ranked(j.select("doc_id", "lang", "tier"), ["lang", "tier", "doc_id"])
    first = r.groupBy(F.col("lang").alias("of")).agg(F.min("rank").alias("first"))
    return r.join(first, F.col("lang").eqNullSafe(F.col("of"))).select("doc_id", "lang", "tier", (F.col("rank") - F.col("first") + 1).cast("int").alias("pos"))


def splice_order(spark, sf):
    """Line items as blocks of their order, two marks spliced by price."""
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ix")).agg(F.max("l_quantity").alias("y"))
    l = l.withColumn("y", F.when(F.col("ix") % 4 != 0, F.col("y")))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("ix"), (F.col("o_totalprice") % 50).alias("y")), F.struct(F.lit(2).alias("kind"), F.lit(0).alias("ix"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(25.0)).alias("y")))).alias("s")).select("k", "s.*")
    return emit.ordered(l, o, ["k"])


def grid_markdown(spark, sf):
    """Nations as one table for each region."""
    n = table(spark, sf, "nation")
    r = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    body = n.withColumn("row", r).select("n_regionkey", "row", F.explode(F.array(F.struct(F.lit(0).alias("col"), F.concat(F.col("n_name"), F.lit("|x")).alias("text")), F.struct(F.lit(1).alias("col"), F.col("n_nationkey").cast("string").alias("text")))).alias("c")).select("n_regionkey", "row", "c.col", "c.text")
    head = n.select("n_regionkey").distinct().select("n_regionkey", F.lit(0).alias("row"), F.explode(F.array(F.struct(F.lit(0).alias("col"), F.lit("name").alias("text")), F.struct(F.lit(1).alias("col"), F.lit("key").alias("text")))).alias("c")).select("n_regionkey", "row", "c.col", "c.text")
    cells = head.unionByName(body).withColumn("ix", F.col("row") * 2 + F.col("col"))
    return emit.grid(cells, ["n_regionkey"]).select("n_regionkey", "markdown")


def merged_cells(spark, sf):
    """Grid cells that no merge covers but at its own corner."""
    n = table(spark, sf, "nation").select(F.floor(F.col("n_nationkey") / 5).cast("int").alias("row"), (F.col("n_nationkey") % 5).cast("int").alias("col"), "n_name")
    m = table(spark, sf, "region").select(F.col("r_regionkey").alias("r0"), (F.col("r_regionkey") % 3).alias("c0"), F.col("r_regionkey").alias("r1"), (F.col("r_regionkey") % 3 + 1).alias("c1"))
    inside = (F.col("row") >= F.col("r0")) & (F.col("row") <= F.col("r1")) & (F.col("col") >= F.col("c0")) & (F.col("col") <= F.col("c1"))
    return n.join(m, inside & ~((F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))), "left_anti")


def node_features(spark, sf):
    r = _rows(spark, sf)
    w = Window.partitionBy("doc_id", "page")
    f = r.withColumns({"lo": F.min("row").over(w), "hi": F.max("row").over(w)})
    return f.select("doc_id", "page", "row", G.width_class(F.col("x1") - F.col("x0"), F.lit(612)).alias("w_class"), G.char_class(F.length("text")).alias("char_class"), G.grid_pm(F.col("x0"), F.lit(612)).alias("x_pm"), G.grid_pm(F.col("y0"), F.lit(792)).alias("y_pm"), (F.col("row") - F.col("lo") < 2).alias("at_top"), (F.col("hi") - F.col("row") < 2).alias("at_bottom"))


def windows_carry(spark, sf):
    b = texts.text_blocks(table(spark, sf, "documents")).select("doc_id", "block_ix")
    return trees.windows(b, ["doc_id"], "block_ix", cap=8, carry=2).withColumn("window", F.col("window").cast("long"))


def _samples(spark, sf):
    e = table(spark, sf, "events")
    op = F.element_at(F.array(*(F.lit(x) for x in ("move_before", "move_after", "reparent", "merge_flow", "flag_break"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.floor(F.col("event_id") / 40).alias("page"), (F.col("event_id") % 3).alias("sample_ix"), op.alias("op"), (F.col("user_id") % 4).alias("node"), F.when(F.col("event_id") % 7 != 0, (F.col("user_id") % 3)).alias("ref"), F.floor(F.col("value") * 100 % 1000).cast("long").alias("confidence_pm"))


_SAMPLES = """samples AS (SELECT event_id // 40 AS page, event_id % 3 AS sample_ix, ['move_before', 'move_after', 'reparent', 'merge_flow', 'flag_break'][event_id % 5 + 1] AS op, user_id % 4 AS node,
  CASE WHEN event_id % 7 <> 0 THEN user_id % 3 END AS ref, CAST(floor(value * 100 % 1000) AS BIGINT) AS confidence_pm FROM events),
voted AS (SELECT page, op, node, ref, count(DISTINCT sample_ix) AS votes, max(confidence_pm) AS confidence_pm FROM samples
  WHERE (page, sample_ix) NOT IN (SELECT (page, sample_ix) FROM samples GROUP BY page, sample_ix HAVING count(*) FILTER (op <> 'flag_break') > 12) GROUP BY 1, 2, 3, 4)"""


def vote_majority(spark, sf):
    return votes.votes(_samples(spark, sf), PAGE).where(F.col("votes") >= votes.LEAST_VOTES)


def verdicts(spark, sf):
    s = _samples(spark, sf)
    nodes = s.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("node")).withColumn("context", (F.col("node") == 2) & (F.col("page") % 2 == 0))
    v = votes.verdicts(votes.votes(s, PAGE).withColumnRenamed("page", "w"), nodes.select(F.col("page").alias("w"), "node", F.col("node").alias("page"), "context"), ["w"])
    return v.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("votes").alias("votes"))


def latest_arrangement(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return trees.latest(e.join(table(spark, sf, "events").select("event_id", "ts"), "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def kendall_tau(spark, sf):
    """Turn order against length order of each conversation."""
    c = table(spark, sf, "conversations")
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.length("text"), "turn"))
    return trees.kendall(c.select("conv_id", "turn", r.alias("by_length")), ["conv_id"], "turn", "by_length")


_FUNCS = (
    two_column_bands, occupancy, gutters, frames, tab_stops, order_ties, separators, bbox_union, page_em, page_gates, rect_round_modes, span_join, line_join_health, table_zone_semi,
    coverage_gate, kv_gap_clusters, kv_containment, continuity_edges, heading_nesting, tree_paths, tree_preorder, tree_validate, fallback_unclaimed, body_merge, splice_order, grid_markdown,
    merged_cells, node_features, windows_carry, vote_majority, verdicts, latest_arrangement, kendall_tau,
)
QUERIES = {f.__name__: f for f in _FUNCS}

_KV = "kv AS (SELECT event_id, user_id AS page, CAST(floor(epoch(ts)) AS BIGINT) AS y0, CAST(floor(epoch(ts)) AS BIGINT) + 1 AS y1 FROM events)"
SQL = {
    "two_column_bands": f"WITH {_TWO} SELECT page, CAST(atom_ix AS BIGINT) AS atom_ix, CAST(dense_rank() OVER (PARTITION BY page ORDER BY y0) - 1 AS INTEGER) AS band FROM atoms",
    "occupancy": f"WITH {_TWO} SELECT page, bucket, occ, k FROM occ",
    "gutters": f"WITH {_TWO} SELECT page, CAST(gutter_ix AS INTEGER) AS gutter_ix, gx0, gx1 FROM gut",
    "frames": f"WITH {_TWO} SELECT page, CAST(frame_ix AS INTEGER) AS frame_ix, fx0 AS frame_x0, fx1 AS frame_x1, adv, cells, CAST(coalesce(sum(cells + 3) OVER (PARTITION BY page ORDER BY frame_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS col_start FROM cells",
    "tab_stops": f"WITH {_TWO}, c AS (SELECT h.page, h.frame_ix, h.atom_ix, greatest((h.x0 - a.fx0) // a.adv, 0) AS col FROM homed h JOIN adv a USING (page, frame_ix)) SELECT page, CAST(frame_ix AS INTEGER) AS frame_ix, atom_ix, col, mode(col) OVER (PARTITION BY page, frame_ix) AS stop FROM c",
    "order_ties": f"WITH {_TWO} SELECT a.page, a.atom_ix, b.atom_ix AS next_ix, CAST(0 AS BIGINT) AS margin FROM atoms a JOIN atoms b ON a.page = b.page AND a.row = b.row AND a.atom_ix < b.atom_ix",
    "separators": f"WITH {_WRAP}, r AS (SELECT *, max(x1) OVER w - min(x0) OVER w AS wide, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY row) - 1 AS INTEGER) AS band FROM rects WINDOW w AS (PARTITION BY doc_id, page)) SELECT doc_id, page, band, 10 * (x1 - x0) >= 9 * wide AS separator FROM r",
    "bbox_union": f"WITH {_WRAP} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rects GROUP BY 1, 2",
    "page_em": f"WITH {_WRAP} SELECT doc_id, page, CAST(list_sort(list((y1 - y0) * 1000))[(count(*) - 1) // 4 + 1] AS BIGINT) AS em FROM rects GROUP BY 1, 2",
    "page_gates": f"WITH {_WRAP} SELECT w.doc_id, w.page, count(*) FILTER (w.text <> '') AS atoms, CASE WHEN count(*) FILTER (w.text <> '') = 0 OR w.doc_id % 7 = 0 THEN 'no-geometry' WHEN count(*) FILTER (w.text <> '') > 4000 THEN 'too-dense' ELSE '' END AS declined FROM wrapped w GROUP BY 1, 2",
    "rect_round_modes": f"SELECT l_orderkey, l_linenumber, CAST(round_even({_K}, 0) AS BIGINT) AS even, CAST(floor(({_K}) * 1000 + 0.5) AS BIGINT) AS half_up, CAST(floor((floor(({_K}) * 1000 + 0.5) + 500) / 1000) AS BIGINT) AS back FROM lineitem",
    "span_join": f"WITH {_SPANS} SELECT doc_id, line_ix, block_ix FROM cuts",
    "line_join_health": f"WITH {_SPANS} SELECT doc_id, count(*) AS attached, count(*) AS total FROM cuts GROUP BY 1",
    "table_zone_semi": f"WITH {_SPANS} SELECT c.doc_id, c.line_ix FROM cuts c JOIN paras p ON c.doc_id = p.doc_id AND c.block_ix = p.block_ix WHERE p.s LIKE '%|%'",
    "coverage_gate": "SELECT doc_id, true AS covered FROM documents",
    "kv_gap_clusters": f"WITH {_KV}, t AS (SELECT *, max(y1) OVER (PARTITION BY page ORDER BY y0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM kv), c AS (SELECT *, CAST(sum(CASE WHEN y0 - top > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y0, event_id) AS BIGINT) AS cluster FROM t) SELECT page, cluster, count(*) AS pairs, min(y0) AS y0, max(y1) AS y1 FROM c GROUP BY 1, 2",
    "kv_containment": f"WITH {_KV}, r AS (SELECT *, y0 % 3600 AS s FROM kv) SELECT event_id, (SELECT CAST(min(i) AS INTEGER) FROM range(0, 4) t(i) WHERE s >= i * 900 AND s + 1 <= i * 900 + 900 - i * 10) AS whole_ix, (SELECT CAST(min(i) AS INTEGER) FROM range(0, 4) t(i) WHERE s >= i * 900 AND s <= i * 900 + 900 - i * 10) AS centre_ix FROM r",
    "continuity_edges": f"""WITH {_BLOCKS}, m AS (
  SELECT b.doc_id, block_ix, {_LAST.replace('text', 'b.text')} IN ('-', '‐', '‑', chr(173)) AS h, {_LAST.replace('text', 'b.text')} IN ('.', '!', '?', '…', '。', '！', '？', '؟', '۔') AS e,
    CASE WHEN {_VOID.format(t='d.text')} THEN false ELSE coalesce(regexp_matches(regexp_extract(b.text, '[\\p{{Lu}}\\p{{Ll}}]'), '\\p{{Ll}}'), false) END AS s FROM blocks b JOIN documents d ON b.doc_id = d.doc_id
), p AS (SELECT doc_id, block_ix AS src_ix, lead(block_ix) OVER w AS dst_ix, h, e, lead(s) OVER w AS s FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY block_ix)),
q AS (SELECT *, h::INT * 3 + (NOT e)::INT + s::INT * 2 + 3 AS score FROM p WHERE dst_ix IS NOT NULL)
SELECT doc_id, src_ix, dst_ix, score, concat_ws(',', CASE WHEN h THEN 'ends_hyphen' END, CASE WHEN NOT e THEN 'no_terminal' END, CASE WHEN s THEN 'starts_lower' END, 'height_match', 'adjacency') AS evidence FROM q WHERE score >= 4""",
    "heading_nesting": f"""WITH {_BLOCKS}, l AS (SELECT doc_id, block_ix AS ix, CASE WHEN length(text) < 40 THEN 1 WHEN length(text) < 60 THEN 2 WHEN length(text) < 70 THEN 3 WHEN length(text) < 80 THEN 4 END AS level FROM blocks)
SELECT doc_id, ix, level, (SELECT max(b.ix) FROM l b WHERE b.doc_id = a.doc_id AND b.ix < a.ix AND b.level < coalesce(a.level, 5)) AS parent_ix FROM l a""",
    "tree_paths": """SELECT 'doc' AS id, '/doc' AS path UNION ALL SELECT 'r' || r_regionkey, '/doc/sect[' || row_number() OVER (ORDER BY r_regionkey) || ']' FROM region
UNION ALL SELECT 'n' || n_nationkey, '/doc/sect[' || rn || ']/sect[' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || ']' FROM nation JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS rn FROM region) ON r_regionkey = n_regionkey
UNION ALL SELECT 'c' || c_custkey, '/doc/sect[' || rn || ']/sect[' || nn || ']/' || CASE WHEN c_custkey % 5 = 0 THEN 'h' ELSE 'p' END || '[' || row_number() OVER (PARTITION BY c_nationkey, c_custkey % 5 = 0 ORDER BY c_custkey) || ']'
FROM customer JOIN (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nn FROM nation) ON n_nationkey = c_nationkey JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS rn FROM region) ON r_regionkey = n_regionkey""",
    "tree_preorder": """WITH o AS (SELECT 'doc' AS id, -1 AS a, -1 AS b, -1 AS c UNION ALL SELECT 'r' || r_regionkey, r_regionkey, -1, -1 FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey, n_nationkey, -1 FROM nation
UNION ALL SELECT 'c' || c_custkey, n_regionkey, n_nationkey, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT id, row_number() OVER (ORDER BY a, b, c) - 1 AS pre_id FROM o""",
    "tree_validate": "WITH c AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 0), n AS (SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, count(c.doc_id) AS claims, bool_or(d.doc_id IS NOT NULL) AS known FROM documents d FULL JOIN c ON d.doc_id = c.doc_id GROUP BY 1) SELECT doc_id, claims, known FROM n WHERE claims <> 1 OR NOT known",
    "fallback_unclaimed": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "body_merge": "WITH t AS (SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0 ELSE 3 END AS tier FROM documents) SELECT doc_id, lang, tier, CAST(row_number() OVER (PARTITION BY lang ORDER BY tier, doc_id) AS INTEGER) AS pos FROM t",
    "splice_order": """WITH b AS (SELECT l_orderkey AS k, l_linenumber AS ix, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity ELSE 1e300 END AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS n FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)),
s AS (SELECT o_orderkey AS k, 1 AS kind, 0 AS ix, o_totalprice % 50 AS y FROM orders UNION ALL SELECT o_orderkey, 2, 0, CASE WHEN o_orderkey % 2 = 0 THEN 25.0 ELSE 1e301 END FROM orders),
p AS (SELECT s.k, kind, s.ix, coalesce(min(b.n) FILTER (b.y >= s.y), 1000000) AS slot, 0 AS is_block, s.y FROM s LEFT JOIN b ON b.k = s.k GROUP BY s.k, kind, s.ix, s.y
  UNION ALL SELECT k, 3, ix, n, 1, 0 FROM b)
SELECT k, CAST(kind AS INTEGER) AS kind, CAST(ix AS INTEGER) AS ix, CAST(row_number() OVER (PARTITION BY k ORDER BY slot, is_block, y, kind, ix) - 1 AS INTEGER) AS pos FROM p""",
    "grid_markdown": "SELECT n_regionkey, '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || '\\|x | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1",
    "merged_cells": "SELECT CAST(n_nationkey // 5 AS INTEGER) AS row, CAST(n_nationkey % 5 AS INTEGER) AS col, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_nationkey // 5 AND n_nationkey % 5 = r_regionkey % 3 + 1)",
    "node_features": f"""WITH {_WRAP}, f AS (SELECT *, min(row) OVER w AS lo, max(row) OVER w AS hi, x1 - x0 AS wd FROM rects WINDOW w AS (PARTITION BY doc_id, page))
SELECT doc_id, page, row, CASE WHEN wd < 38.25 THEN 'lt_1_16' WHEN wd < 76.5 THEN 'lt_1_8' WHEN wd < 153 THEN 'lt_1_4' WHEN wd < 306 THEN 'lt_1_2' WHEN wd < 459 THEN 'lt_3_4' ELSE 'ge_3_4' END AS w_class,
  CASE WHEN length(text) < 8 THEN 'xs' WHEN length(text) < 32 THEN 's' WHEN length(text) < 128 THEN 'm' WHEN length(text) < 512 THEN 'l' ELSE 'xl' END AS char_class,
  ((200 * x0 + 612) // 1224) * 10 AS x_pm, ((200 * y0 + 792) // 1584) * 10 AS y_pm, row - lo < 2 AS at_top, hi - row < 2 AS at_bottom FROM f""",
    "windows_carry": f"""WITH {_BLOCKS}, n AS (SELECT doc_id, block_ix, count(*) OVER (PARTITION BY doc_id) AS t FROM blocks), u AS (SELECT doc_id, block_ix, CAST(block_ix // 8 AS BIGINT) AS "window", false AS context FROM n
  UNION ALL SELECT doc_id, block_ix, CAST(block_ix // 8 + 1 AS BIGINT), true FROM n WHERE block_ix % 8 >= 6 AND (block_ix // 8 + 1) * 8 < t)
SELECT doc_id, block_ix, "window", context, CAST(row_number() OVER (PARTITION BY doc_id, "window" ORDER BY block_ix) - 1 AS INTEGER) AS place FROM u""",
    "vote_majority": f"WITH {_SAMPLES} SELECT page, op, node, ref, votes, confidence_pm FROM voted WHERE votes >= 2",
    "verdicts": f"""WITH {_SAMPLES}, v AS (SELECT votes, CASE WHEN node > 2 THEN 'REJECT_UNKNOWN_ID' WHEN (page % 2 = 0 AND node = 2) OR (page % 2 = 0 AND ref = 2 AND op <> 'merge_flow') THEN 'REJECT_CONTEXT_TARGET'
  WHEN ref IS NOT NULL AND ref <> node THEN 'REJECT_PAGE_CROSS' WHEN confidence_pm < 700 THEN 'REJECT_CONFIDENCE' WHEN votes < 2 THEN 'REJECT_MAJORITY' ELSE 'ACCEPT' END AS verdict FROM voted)
SELECT verdict, count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes FROM v GROUP BY 1""",
    "latest_arrangement": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "kendall_tau": """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS n FROM conversations),
p AS (SELECT a.conv_id, count(*) AS pairs, count(*) FILTER (a.n > b.n) AS discordant FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1)
SELECT conv_id, pairs, discordant, CAST(floor((pairs - 2 * discordant) * 1000 / pairs) AS BIGINT) AS tau_pm FROM p""",
}
