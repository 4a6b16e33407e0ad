"""Queries over the small rules, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import emit, rules
from ..sources import catalog
from .catalogue_text import _WRAP, table


def distinct_atoms(spark, sf):
    """Events as atoms of their user's page: rectangles of few sizes, some tagged."""
    e = table(spark, sf, "events")
    n = lambda m, by: (F.col("event_id") % m * by).cast("long")
    a = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("atom_ix"), "event_type", n(3, 10).alias("x0"), n(2, 7).alias("y0"), (n(3, 10) + 5).alias("x1"), (n(2, 7) + 5).alias("y1"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 5 == 4, F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string"))).otherwise("").alias("tag"))
    return rules.distinct_atoms(a, ["page"], ["y0", "x0", "atom_ix"]).select("page", "atom_ix", "text", "tag")


def page_skew(spark, sf):
    """Line items as lines of their order's page, sloped by quantity and discount."""
    i = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ix")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    quad = F.array(F.lit(1.0), F.lit(1.0), 1 + F.col("q"), 1 + F.col("d") * 10 - F.lit(0.25), 1 + F.col("q"), F.lit(3.0), F.lit(1.0), F.lit(3.0))
    lines = i.withColumn("e", rules.top_edge(F.when(F.col("ix") != 6, quad))).select("page", "ix", "e.rise", "e.run")
    return rules.page_skew(lines, ["page"], ["ix"])


def safe_names(spark, sf):
    """Event types, document ids and pieces of digests as names."""
    e = table(spark, sf, "events")
    role = F.when(F.col("event_id") % 4 == 0, F.concat("event_type", F.lit(" x"))).when(F.col("event_id") % 4 == 1, "footnote").when(F.col("event_id") % 4 == 2, F.col("event_type"))
    doc = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a/b"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("doc:"), F.col("event_id").cast("string")))
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    key = F.when(F.col("event_id") % 5 == 0, h).when(F.col("event_id") % 5 == 1, F.concat(F.lit("{"), h, F.lit("}"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("urn:uuid:"), h)).when(F.col("event_id") % 5 == 3, F.substring(h, 1, 31))
    return e.select("event_id", rules.safe_role(role).alias("role"), rules.safe_doc_id(doc).alias("doc_id"), rules.may_be_uuid(key).alias("addressable"))


def one_input(spark, sf):
    """Requests with none to four inputs."""
    e = table(spark, sf, "events")
    given = [F.when(F.col("event_id") % m == r, F.lit("x")) for m, r in ((2, 0), (3, 0), (5, 0), (7, 0))]
    return e.select("event_id", rules.one_input(*given).alias("i")).select("event_id", "i.source", "i.status")


def figure_ids(spark, sf):
    """Line items as figures on three pages of an order, every fourth without a rectangle."""
    i = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("figure_ix")).agg(F.max("l_quantity").cast("long").alias("q"))
    f = i.select("doc", "figure_ix", (F.col("figure_ix") % 3).alias("page"), *(F.when(F.col("q") % 4 != 0, v).alias(n) for n, v in (("y0", F.col("q") % 6), ("x0", F.col("q") % 5))))
    return rules.figure_ids(f, ["doc"]).select("doc", "figure_ix", "figure_id")


def tag_histogram(spark, sf):
    return rules.tag_histogram(emit.wrapped_markdown(table(spark, sf, "documents")).select("markdown"))


def tree_headings(spark, sf):
    """Blocks as headings of depths from below one to beyond the deepest."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ix", "t")).where("trim(t) <> ''")
    return d.select("doc_id", "ix", F.sha2(rules.tree_heading(F.when(F.col("ix") % 9 == 0, F.concat(F.lit("#"), F.trim("t"))).otherwise(F.trim("t")), F.col("ix") % 8), 256).alias("sha256_heading"))


def fences(spark, sf):
    """Fences around turns of conversations, some of which have runs of backticks."""
    c = table(spark, sf, "conversations")
    rows = F.array(F.coalesce("text", F.lit("")), F.repeat(F.lit("`"), (F.col("conv_id") % 6).cast("int")))
    return c.select("conv_id", "turn", T.fence(rows).alias("fence"))


def height_classes(spark, sf):
    """Line items as lines of heights by quantity, on pages of an em by discount."""
    i = table(spark, sf, "lineitem")
    h, em = (F.col("l_quantity") * 100).cast("long"), (F.col("l_discount") * 20_000).cast("long")
    return i.groupBy(G.height_class(h, em).alias("height_class")).agg(F.count("*").alias("n"))


def statuses(spark, sf):
    """Outcomes of events as requests that failed in one way or another."""
    e = table(spark, sf, "events")
    error = F.element_at(F.array(*map(F.lit, ("timeout", "recognition", "unsupported_media_type", "invalid", "needs_ocr", "too_large", "other"))), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", catalog.status_of(F.when(F.col("event_id") % 11 != 0, error)).alias("status"))


def store_keys(spark, sf):
    """Keys of markdown, trees, their variants and arrangements by the time of events."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    i = F.col("event_id").cast("string")
    sha8 = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("."), F.substring(F.sha2(i, 256), 1, 8))).otherwise("")
    k = lambda p, x, s: catalog.store_key(p, F.col("at"), x, s)
    return e.select("event_id", k("md", i, "md").alias("markdown"), k("tree", i, "tree.json").alias("tree"), k("treemd", F.concat(i, sha8), "md").alias("tree_markdown"), k("arr", F.concat(i, F.lit("."), (F.col("event_id") % 3).cast("string")), "arr.json").alias("arrangement"))


_FUNCS = (distinct_atoms, page_skew, safe_names, one_input, figure_ids, tag_histogram, tree_headings, fences, height_classes, statuses, store_keys)
QUERIES = {f.__name__: f for f in _FUNCS}

SQL = {
    "distinct_atoms": """WITH a AS (SELECT user_id AS page, event_id AS i, event_id % 3 AS x, event_id % 2 AS y, event_type AS text, CASE WHEN event_id % 5 = 4 THEN 't' || event_id % 7 END AS tag FROM events)
SELECT page, min(i) AS atom_ix, text, coalesce(arg_min(tag, i) FILTER (tag IS NOT NULL), '') AS tag FROM a GROUP BY page, x, y, text""",
    "page_skew": """WITH i AS (SELECT l_orderkey AS page, l_linenumber AS ix, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1, 2),
l AS (SELECT page, ix, CASE WHEN ix = 6 THEN 0 ELSE CAST(floor((1 + d * 10 - CAST(0.25 AS DOUBLE)) * 1000 + 0.5) AS BIGINT) - 1000 END AS rise, CASE WHEN ix = 6 THEN 1 ELSE greatest(CAST(floor((1 + q) * 1000 + 0.5) AS BIGINT) - 1000, 1) END AS run FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY abs(rise) / CAST(run AS DOUBLE), ix) AS k, count(*) OVER (PARTITION BY page) AS n FROM l)
SELECT page, CAST(rise AS BIGINT) AS rise, CAST(run AS BIGINT) AS run, abs(rise) * 50 > run AS skewed FROM r WHERE k = (n - 1) // 2 + 1""",
    "safe_names": """SELECT event_id, CASE WHEN event_id % 4 = 2 AND regexp_full_match(event_type, '[A-Za-z][A-Za-z0-9_.-]{0,63}') THEN event_type END AS role, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'doc:' || event_id END AS doc_id, event_id % 5 IN (0, 1) AS addressable FROM events""",
    "one_input": """WITH g AS (SELECT event_id, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b, event_id % 5 = 0 AS c, event_id % 7 = 0 AS d FROM events), n AS (SELECT *, a::INT + b::INT + c::INT + d::INT AS n FROM g)
SELECT event_id, CASE WHEN n <> 1 THEN NULL WHEN a THEN 'document' WHEN b THEN 'read' WHEN c THEN 'layout' ELSE 'envelope' END AS source, CASE WHEN n = 1 THEN 200 ELSE 400 END AS status FROM n""",
    "figure_ids": """WITH i AS (SELECT l_orderkey AS doc, l_linenumber AS figure_ix, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2), f AS (SELECT doc, figure_ix, figure_ix % 3 AS page, CASE WHEN q % 4 = 0 THEN 0 ELSE q % 6 END AS y, CASE WHEN q % 4 = 0 THEN 0 ELSE q % 5 END AS x FROM i)
SELECT doc, figure_ix, 'fig-' || page || '-' || (1 + (SELECT count(*) FROM f b WHERE b.doc = a.doc AND b.page = a.page AND (b.y, b.x, b.figure_ix) < (a.y, a.x, a.figure_ix))) AS figure_id FROM f a""",
    "tag_histogram": f"WITH {_WRAP} SELECT 'p' AS tag, count(*) AS n FROM rects",
    "tree_headings": """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS ix, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT doc_id, CAST(ix AS INTEGER) AS ix, sha256(repeat('#', CAST(1 + least(greatest(ix % 8, 1), 5) AS INTEGER)) || ' ' || CASE WHEN ix % 9 = 0 THEN chr(92) || '#' || trim(t) WHEN starts_with(trim(t), '#') THEN chr(92) || trim(t) ELSE trim(t) END) AS sha256_heading FROM l WHERE trim(t) <> ''""",
    "fences": "SELECT conv_id, turn, repeat('`', CAST(greatest(3, conv_id % 6 + 1, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1) AS INTEGER)) AS fence FROM conversations",
    "height_classes": """WITH h AS (SELECT CAST(l_quantity * 100 AS BIGINT) AS h, CAST(l_discount * 20000 AS BIGINT) AS em FROM lineitem)
SELECT CASE WHEN em <= 0 OR h <= 0 THEN 'body' WHEN h / CAST(em AS DOUBLE) < 0.85 THEN 'small' WHEN h >= 1.8 * em THEN 'display' WHEN h >= 1.25 * em THEN 'large' ELSE 'body' END AS height_class, count(*) AS n FROM h GROUP BY 1""",
    "statuses": "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 200 ELSE [504, 502, 415, 400, 422, 413, 500][event_id % 7 + 1] END AS status FROM events",
    "store_keys": """WITH e AS (SELECT event_id, strftime(ts, '%Y/%m') AS m FROM events)
SELECT event_id, 'md/' || m || '/' || event_id || '.md' AS markdown, 'tree/' || m || '/' || event_id || '.tree.json' AS tree, 'treemd/' || m || '/' || event_id || CASE WHEN event_id % 2 = 0 THEN '.' || sha256(event_id::VARCHAR)[1:8] ELSE '' END || '.md' AS tree_markdown, 'arr/' || m || '/' || event_id || '.' || event_id % 3 || '.arr.json' AS arrangement FROM e""",
}
