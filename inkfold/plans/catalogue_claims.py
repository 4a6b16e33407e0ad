"""Queries over ownership, levels, windows, recorded answers and artifacts, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import claims, review
from ..sources import texts
from .catalogue_text import table

PAGE = ["page"]


def _items(spark, sf) -> DataFrame:
    """Line items once for each order and number."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("ix")).agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_suppkey").cast("long").alias("s"))


_ITEMS = "items AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS ix, CAST(max(l_quantity) AS BIGINT) AS q, CAST(max(l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2)"


def positional_zip(spark, sf):
    """Blocks of documents and the lines they came from; every ninth document lost its first line, and so all of its pairs."""
    d = table(spark, sf, "documents")
    nodes = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("node_ix", "text")).where((F.col("doc_id") % 9 != 0) | (F.col("node_ix") > 0))
    return claims.zip_positions(texts.text_blocks(d), nodes, ["doc_id"]).select("doc_id", "block_ix", "node_ix")


def containing_table(spark, sf):
    """Line items as blocks of their order's page, some without a rectangle; two tables on two pages of three."""
    b = _items(spark, sf)
    box = lambda c: F.when(F.col("ix") % 5 != 0, c).cast("long")
    b = b.select("page", F.col("ix").alias("block_ix"), box(F.col("q") * 10).alias("x0"), box(F.col("ix") * 100).alias("y0"), box(F.col("q") * 10 + 20).alias("x1"), box(F.col("ix") * 100 + 50).alias("y1"))
    t = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("page"), F.explode(F.array(*(F.struct(F.lit(i).alias("table_ix"), *(F.lit(v).cast("long").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), r))) for i, r in enumerate([(0, 0, 250, 400), (250, 0, 600, 250)])))).alias("t")).select("page", "t.*")
    return claims.containing_table(b, t, PAGE)


def _atoms(spark, sf) -> DataFrame:
    """Line items as atoms of pages of a supplier: a block's atoms lie in several regions and frames."""
    i = _items(spark, sf)
    return i.select(F.col("s").alias("page"), F.col("page").alias("order"), "ix", F.when(F.col("ix") == 7, "mark").otherwise("line").alias("kind"), F.when(F.col("q") > 5, F.col("page") % 40).alias("block_ix"), ((F.col("ix") + F.col("q")) % 3).alias("region_ix"), (F.col("q") % 2).alias("frame_ix"), F.col("q").alias("band"))


_ATOMS = f"{_ITEMS}, atoms AS (SELECT s AS page, page AS \"order\", ix, CASE WHEN ix = 7 THEN 'mark' ELSE 'line' END AS kind, CASE WHEN q > 5 THEN page % 40 END AS block_ix, (ix + q) % 3 AS region_ix, q % 2 AS frame_ix, q AS band FROM items)"


def home_frames(spark, sf):
    a = _atoms(spark, sf).where("block_ix IS NOT NULL")
    return claims.home_of_first(a, PAGE, ["kind", "block_ix"], ["band", "order", "ix"])


def owned_atoms(spark, sf):
    return claims.owned_atoms(_atoms(spark, sf), PAGE).select("page", "order", "ix", "region_ix")


def _edges(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id"), (F.col("event_id") % 30).alias("src"), (F.col("event_id") % 30 + 1 + F.col("event_id") % 7).alias("dst"))
    return e.where("event_id % 5 <> 0").withColumn("kind", F.when(F.col("event_id") % 4 == 0, "follows").otherwise("continues")), e.where("event_id % 5 = 0")


def flow_successors(spark, sf):
    """Events as flow edges of their user's document, every fifth an accepted join."""
    e, j = _edges(spark, sf)
    return claims.flow_successors(e, j, ["doc"])


def window_ties(spark, sf):
    """Neighbouring nodes that tie, and the windows that hold both; windows overlap by two nodes."""
    e = table(spark, sf, "events")
    nodes = e.select(F.col("user_id").alias("doc"), (F.col("event_id") % 24).alias("node")).distinct()
    members = nodes.select("doc", "node", F.explode(F.array(F.floor(F.col("node") / 8), F.floor((F.col("node") + 2) / 8))).alias("window"))
    ties = nodes.where("node % 3 <> 0").select("doc", F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    return claims.ties_in_window(ties, members, ["doc"])


def kv_on_canvas(spark, sf):
    """First and last word of each turn as a pair; the other role's turns are on the canvas."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    words = F.split(F.trim("text"), " ")
    pairs = c.where("role = 'user'").select(F.col("conv_id").alias("page"), "turn", F.element_at(words, 1).alias("key"), F.element_at(words, -1).alias("value"))
    atoms = c.where("role <> 'user'").select(F.col("conv_id").alias("page"), "text")
    return claims.said_on_canvas(pairs, atoms, PAGE).select("page", "turn", "on_canvas")


def telling_declines(spark, sf):
    """Line items as regions of a page that were not laid out, for reasons by their quantity."""
    i = _items(spark, sf)
    reason = F.element_at(F.array(*map(F.lit, claims.DECLINES)), (F.col("q") % 7 + 1).cast("int"))
    return claims.telling_decline(i.withColumn("reason", reason), PAGE)


def heading_levels(spark, sf):
    """Line items as headings of their order: heights by quantity, a title in every fourth order."""
    i = _items(spark, sf)
    h = F.element_at(F.array(*map(F.lit, ("small", "display", "body", "large"))), (F.col("q") % 4 + 1).cast("int"))
    return claims.heading_levels(i.select("page", "ix", ((F.col("page") % 4 == 0) & (F.col("ix") == 2)).alias("is_title"), h.alias("height_class")), PAGE).select("page", "ix", F.col("level").cast("int").alias("level"))


def footnotes_last(spark, sf):
    """Line items as leaves of two sections of an order; every third quantity is a footnote, some without a place."""
    i = _items(spark, sf)
    leaves = i.select("page", (F.col("ix") % 2).alias("section"), F.col("ix").alias("pos"), F.when(F.col("q") % 3 == 0, "footnote").otherwise("paragraph").alias("kind"), F.when(F.col("q") % 2 == 0, 50 - F.col("q")).alias("y0"), F.lit(None).cast("long").alias("x0"), "ix")
    out = claims.footnotes_last(leaves.withColumnRenamed("page", "doc").withColumn("page", F.lit(1)), ["doc"])
    return out.select("doc", "section", "ix", "place")


def band_windows(spark, sf):
    """Blocks of documents as nodes, three or so to a band, in windows of eight that end with a band where they can."""
    b = texts.text_blocks(table(spark, sf, "documents")).select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), F.floor((F.col("block_ix") * F.col("block_ix") % 11 + F.col("block_ix") * 4) / 13).alias("band"))
    return review.band_windows(b, ["doc_id"], "block_ix", "band", 8).select("doc_id", "block_ix", "window")


def _answers(spark, sf):
    """Recorded answers made of events: fenced, bare, cut off, of an unknown kind, of a wrong type, or not an object."""
    e = table(spark, sf, "events")
    op = F.element_at(F.array(*map(F.lit, ("move_before", "reparent", "merge_flow", "swap"))), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.concat(F.lit('{"ops":[{"op":"'), op, F.lit('","node":'), F.col("user_id").cast("string"), F.lit(',"ref":'), (F.col("event_id") % 9).cast("string"), F.lit(',"confidence":'), F.when(F.col("event_id") % 13 == 0, "1.5").otherwise("0.75"), F.lit("}]}"))
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("event_id") % 7 == 1, F.substring(body, 1, 20)).when(F.col("event_id") % 7 == 2, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return e.select("event_id", text.alias("text"))


def parsed_samples(spark, sf):
    got = review.parsed_samples(_answers(spark, sf))
    return got.select("event_id", F.coalesce("discarded", F.lit("")).alias("discarded"), F.coalesce(F.size("ops"), F.lit(0)).alias("ops"), F.get("ops", F.lit(0))["op"].alias("first_op"), F.get("ops", F.lit(0))["node"].alias("first_node"))


def replayed_samples(spark, sf):
    """Answers recorded under the hash of what was asked; every third question was never put."""
    e = table(spark, sf, "events")
    asked = e.select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("payload"))
    answers = asked.select("payload").distinct().where(F.length("payload") % 3 != 0).select(F.sha2("payload", 256).alias("payload_sha256"), F.lit(0).alias("sample_ix"), F.upper("payload").alias("text"))
    return review.replayed(asked, answers).select("event_id", "payload_sha256", "text")


def candidate_order(spark, sf):
    """Events as votes of samples for edits of a page; each edit once, in the order in which edits are tried."""
    e = table(spark, sf, "events")
    op = F.element_at(F.array(*map(F.lit, review.EDIT_RANK)), (F.col("event_id") % 5 + 1).cast("int"))
    ops = e.select(F.floor(F.col("event_id") / 50).alias("doc"), (F.col("user_id") % 3).alias("page"), (F.col("event_id") % 3).alias("sample_ix"), F.col("event_id").alias("op_ix"), op.alias("op"), (F.col("user_id") % 6).alias("node"), F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 2).alias("ref"))
    return review.candidate_order(ops, ["doc"]).select("doc", "pos", "page", "op", "node", "ref", "sample_ix")


def artifacts(spark, sf):
    """Canonical records of passes over documents that ran, were skipped or failed, by their hashes."""
    d = table(spark, sf, "documents")
    status = F.element_at(F.array(F.lit("ran"), F.lit("skipped"), F.lit("error")), (F.col("doc_id") % 3 + 1).cast("int"))
    reason = F.when(F.col("doc_id") % 3 == 2, "ValueError").when(F.col("doc_id") % 2 == 0, "timeout").otherwise("tired")
    a = review.artifact(F.concat(F.lit("dé-"), F.col("doc_id").cast("string")), F.sha2(F.coalesce("text", F.lit("")), 256), status, reason, F.lit("stub"), F.lit(3), F.col("doc_id") % 4, F.lit(0))
    return d.select("doc_id", F.sha2(a, 256).alias("sha256_artifact"))


def tree_violations(spark, sf):
    """Orders as trees: line items are paragraphs of the body, some under the item after them, some orders without furniture."""
    i = _items(spark, sf)
    o = i.groupBy("page").agg(F.count("*").alias("n"))
    up = F.when((F.col("page") % 5 == 0) & (F.col("r") == 1) & (F.col("n") > 1), F.col("r") + 2).otherwise(F.lit(1))
    w = Window.partitionBy("page")
    leaves = i.withColumns({"r": F.row_number().over(w.orderBy("ix")).cast("long"), "n": F.count("*").over(w)}).select("page", (F.col("r") + 1).alias("id"), up.cast("long").alias("parent"), F.when(F.col("q") % 4 == 0, "table").otherwise("paragraph").alias("kind"))
    top = o.select("page", F.explode(F.array(*(F.struct(i_.alias("id"), p.alias("parent"), F.lit(k).alias("kind")) for i_, p, k in ((F.lit(0).cast("long"), F.lit(None).cast("long"), "document"), (F.lit(1).cast("long"), F.lit(0).cast("long"), "body"), ((F.col("n") + 2).cast("long"), F.lit(0).cast("long"), "furniture"))))).alias("x")).select("page", "x.*")
    top = top.where((F.col("page") % 7 != 0) | (F.col("kind") != "furniture"))
    flow = o.where("n > 1").select("page", F.lit(2).cast("long").alias("src"), F.lit(3).cast("long").alias("dst"))
    return review.violations(top.unionByName(leaves), flow, PAGE)


def tree_modes(spark, sf):
    """Requests and settings of events."""
    e = table(spark, sf, "events")
    asked = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    setting = F.element_at(F.array(F.lit("off"), F.lit("build"), F.lit("emit")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select("event_id", review.tree_mode(asked, setting).alias("mode"))


_FUNCS = (
    positional_zip, containing_table, home_frames, owned_atoms, flow_successors, window_ties, kv_on_canvas, telling_declines, heading_levels, footnotes_last, band_windows, parsed_samples,
    replayed_samples, candidate_order, artifacts, tree_violations, tree_modes,
)
QUERIES = {f.__name__: f for f in _FUNCS}

SQL = {
    "positional_zip": """WITH l AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS i, unnest(string_split(text, chr(10))) AS s FROM documents),
b AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS block_ix, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE trim(s) <> ''),
m AS (SELECT doc_id, i AS node_ix, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE trim(s) <> '' AND (doc_id % 9 <> 0 OR i > 0))
SELECT b.doc_id, b.block_ix, m.node_ix FROM b JOIN m ON b.doc_id = m.doc_id AND b.block_ix = m.k AND b.n = m.n""",
    "containing_table": f"""WITH {_ITEMS}, b AS (SELECT page, ix AS block_ix, CASE WHEN ix % 5 <> 0 THEN q * 10 + 10 END AS cx, CASE WHEN ix % 5 <> 0 THEN ix * 100 + 25 END AS cy FROM items)
SELECT page, block_ix, CASE WHEN page % 3 = 0 OR page NOT IN (SELECT o_orderkey FROM orders) THEN NULL WHEN cx BETWEEN 0 AND 250 AND cy BETWEEN 0 AND 400 THEN 0 WHEN cx BETWEEN 250 AND 600 AND cy BETWEEN 0 AND 250 THEN 1 ELSE 0 END AS table_ix FROM b""",
    "home_frames": f'WITH {_ATOMS} SELECT page, kind, block_ix, arg_min(frame_ix, (band, "order", ix)) AS home FROM atoms WHERE block_ix IS NOT NULL GROUP BY 1, 2, 3',
    "owned_atoms": f"""WITH {_ATOMS} SELECT a.page, a."order", a.ix, a.region_ix FROM atoms a
WHERE a.kind <> 'line' OR a.block_ix IS NULL OR NOT EXISTS (SELECT 1 FROM atoms b WHERE b.page = a.page AND b.block_ix = a.block_ix AND b.kind = 'line' AND b.region_ix < a.region_ix)""",
    "flow_successors": "SELECT user_id AS doc, event_id % 30 AS src, min(event_id % 30 + 1 + event_id % 7) AS dst FROM events WHERE event_id % 5 = 0 OR event_id % 4 <> 0 GROUP BY 1, 2",
    "window_ties": """WITH n AS (SELECT DISTINCT user_id AS doc, event_id % 24 AS node FROM events), m AS (SELECT DISTINCT doc, node, unnest([node // 8, (node + 2) // 8]) AS "window" FROM n)
SELECT a.doc, a."window", a.node AS a, b.node AS b FROM m a JOIN m b ON a.doc = b.doc AND a."window" = b."window" AND b.node = a.node + 1 WHERE a.node % 3 <> 0""",
    "kv_on_canvas": """WITH c AS (SELECT conv_id, turn, role, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM conversations WHERE text IS NOT NULL),
k AS (SELECT conv_id, turn, lower(string_split(trim(text, ' '), ' ')[1]) AS a, lower(string_split(trim(text, ' '), ' ')[-1]) AS b FROM c WHERE role = 'user')
SELECT conv_id AS page, turn, EXISTS (SELECT 1 FROM c WHERE c.conv_id = k.conv_id AND c.role <> 'user' AND contains(c.n, trim(k.a))) AND EXISTS (SELECT 1 FROM c WHERE c.conv_id = k.conv_id AND c.role <> 'user' AND contains(c.n, trim(k.b))) AS on_canvas FROM k""",
    "telling_declines": f"WITH {_ITEMS} SELECT page, ['error', 'coverage', 'multiline', 'too-dense', 'skew', 'no-geometry', 'no-gutter'][min(q % 7) + 1] AS reason FROM items GROUP BY 1",
    "heading_levels": f"""WITH {_ITEMS}, h AS (SELECT page, ix, page % 4 = 0 AND ix = 2 AS t, [3, 0, 2, 1][q % 4 + 1] AS r FROM items)
SELECT page, ix, CAST(CASE WHEN t THEN 1 ELSE least(4, 1 + (SELECT count(DISTINCT r) FROM h b WHERE b.page = a.page AND NOT b.t AND b.r < a.r) + (SELECT max(t::INT) FROM h b WHERE b.page = a.page)) END AS INTEGER) AS level FROM h a""",
    "footnotes_last": f"""WITH {_ITEMS}, l AS (SELECT page AS doc, ix % 2 AS section, ix, q % 3 = 0 AS note, CASE WHEN q % 2 = 0 THEN 50 - q ELSE 0 END AS y FROM items)
SELECT doc, section, ix, CAST(CASE WHEN note THEN (SELECT count(*) FROM l b WHERE b.doc = a.doc AND b.section = a.section AND (NOT b.note OR (b.y, b.ix) < (a.y, a.ix)))
  ELSE (SELECT count(*) FROM l b WHERE b.doc = a.doc AND b.section = a.section AND NOT b.note AND b.ix < a.ix) END AS INTEGER) AS place FROM l a""",
    "band_windows": """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM l WHERE trim(s) <> ''), n AS (SELECT doc_id, k, (k * k % 11 + k * 4) // 13 AS band FROM b), t AS (SELECT doc_id, count(*) AS n FROM n GROUP BY 1),
turns AS (SELECT a.doc_id, a.k FROM n a JOIN n p ON a.doc_id = p.doc_id AND p.k = a.k - 1 WHERE a.band <> p.band),
w AS (SELECT doc_id, 0::BIGINT AS at, 0 AS "window" FROM t UNION ALL
  SELECT w.doc_id, coalesce((SELECT max(k) FROM turns u WHERE u.doc_id = w.doc_id AND u.k > w.at AND u.k <= w.at + 8), w.at + 8)::BIGINT, w."window" + 1 FROM w JOIN t ON t.doc_id = w.doc_id WHERE t.n - w.at > 8)
SELECT n.doc_id, CAST(n.k AS BIGINT) AS block_ix, CAST(max(w."window") AS INTEGER) AS "window" FROM n JOIN w ON w.doc_id = n.doc_id AND w.at <= n.k GROUP BY 1, 2""",
    "parsed_samples": """WITH t AS (SELECT event_id, user_id, event_id % 7 AS f, ['move_before', 'reparent', 'merge_flow', 'swap'][event_id % 4 + 1] AS op, event_id % 13 = 0 AS sure FROM events),
d AS (SELECT *, CASE WHEN f IN (1, 2) THEN 'not_json' WHEN op = 'swap' OR sure THEN 'bad_schema' ELSE '' END AS discarded FROM t)
SELECT event_id, discarded, CASE WHEN discarded = '' THEN 1 ELSE 0 END AS ops, CASE WHEN discarded = '' THEN op END AS first_op, CASE WHEN discarded = '' THEN user_id END AS first_node FROM d""",
    "replayed_samples": "WITH a AS (SELECT event_id, user_id || '|' || event_type AS p FROM events) SELECT event_id, sha256(p) AS payload_sha256, CASE WHEN length(p) % 3 <> 0 THEN upper(p) END AS text FROM a",
    "candidate_order": """WITH o AS (SELECT event_id // 50 AS doc, user_id % 3 AS page, event_id % 3 AS sample_ix, event_id AS op_ix, event_id % 5 AS r, ['move_before', 'move_after', 'reparent', 'merge_flow', 'flag_break'][event_id % 5 + 1] AS op, user_id % 6 AS node, CASE WHEN event_id % 4 <> 0 THEN user_id % 2 END AS ref FROM events),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc, op, node, ref ORDER BY sample_ix, op_ix) = 1)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY page, r, node, coalesce(ref, -1)) - 1 AS INTEGER) AS pos, page, op, node, ref, sample_ix FROM f""",
    "artifacts": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, doc_id % 3 AS k FROM documents)
SELECT doc_id, sha256('{' || CASE WHEN k = 0 THEN '"accepted_ops":' || doc_id % 4 || ',' ELSE '' END || '"doc_id":"d\\u00e9-' || doc_id || '",' || CASE WHEN k = 0 THEN '"model_id":"stub",' ELSE '' END
  || CASE WHEN k = 1 THEN '"reason":"' || CASE WHEN doc_id % 2 = 0 THEN 'timeout' ELSE 'no_llm_configured' END || '",' ELSE '' END || CASE WHEN k = 0 THEN '"review_queue":0,"samples":3,' ELSE '' END
  || '"schema":"inkfold-arrangement/1","sha256_tree":"' || h || '","status":"' || ['ran', 'skipped', 'error:ValueError'][k + 1] || '","verifier_version":"inkfold-verifier/1"}') AS sha256_artifact FROM d""",
    "tree_violations": f"""WITH {_ITEMS}, n AS (SELECT page, ix, q, row_number() OVER (PARTITION BY page ORDER BY ix) AS r, count(*) OVER (PARTITION BY page) AS n FROM items), o AS (SELECT DISTINCT page, n FROM n)
SELECT page, 'I1:preorder' AS violation FROM o WHERE page % 5 = 0 AND n > 1 UNION ALL SELECT page, 'I2:root_children' FROM o WHERE page % 7 = 0
UNION ALL SELECT page, 'I4:flow' FROM n WHERE n > 1 GROUP BY page HAVING bool_or(r <= 2 AND q % 4 = 0)""",
    "tree_modes": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'off' WHEN event_id % 3 = 0 AND user_id % 3 = 0 THEN 'build' ELSE ['off', 'build', 'emit'][user_id % 3 + 1] END AS mode FROM events",
}
