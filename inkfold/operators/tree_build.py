"""Reading-order trees from recognised layouts: the provider's sections as they stand, and what they leave out behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written
from ..sources import provider
from . import emit, patch

_NODE = ["doc_id", "seq", "above", "kind", "page", "block_ix", "table_ix", "figure_ix"]


def leaf_kind(zone, role):
    """What a block is in the tree."""
    return F.when(zone.isin("title", "heading"), "heading").when(role == "footnote", "footnote").otherwise("paragraph")


def _none(*names: str):
    return [F.lit(None).cast("int").alias(n) for n in names]


def provider_tree(p: DataFrame) -> DataFrame:
    """(doc_id, id, parent, kind, path, page, block_ix, table_ix, figure_ix) of every document of a parsed layout, ids in pre-order.

    Under the body come the provider's top sections and elements, each at its first page, in their own order, and after those of a
    page its unclaimed blocks and tables; a section without anything in it is left out. A figure's caption is its child and nowhere
    else; blocks within tables are their table's; running heads and feet are leaves of the furniture, by page, role and index. A
    document without blocks has its document, body and furniture too, and between them what else its layout holds."""
    b = written(provider.blocks(p).select("doc_id", "block_ix", "node_ix", "page", "zone", "role"), "blocks")
    t = written(provider.tables(p).select("doc_id", "table_ix", "page"), "tables")
    cap = written(provider.captions(p).select("doc_id", "figure_ix", F.col("page").alias("f_page"), "paragraph_ix"), "captions")
    h = written(provider.harvest(p).where("depth > 0").select("doc_id", "seq", "above", "kind", "ix"), "harvest")
    flow = b.where("zone NOT IN ('table', 'furniture')").select("doc_id", "block_ix", F.col("node_ix").cast("int").alias("ix"), "page", leaf_kind(F.col("zone"), F.col("role")).alias("leaf"))
    # captions that are blocks of the flow, each with the first figure that says it is its own
    own = cap.join(flow, (cap["doc_id"] == flow["doc_id"]) & (cap["paragraph_ix"] == flow["ix"])).groupBy(flow["doc_id"], "block_ix", "ix").agg(F.min("figure_ix").alias("figure_ix"), F.min("page").alias("page"))
    own = written(own, "own")
    said = h.where("kind = 'paragraph'").join(flow, ["doc_id", "ix"]).join(own.select("doc_id", "ix"), ["doc_id", "ix"], "left_anti")
    leaves = said.select("doc_id", "seq", "above", F.col("leaf").alias("kind"), "page", "block_ix", *_none("table_ix", "figure_ix"))
    leaves = leaves.unionByName(h.where("kind = 'table'").join(t.withColumnRenamed("table_ix", "ix"), ["doc_id", "ix"]).select("doc_id", "seq", "above", "kind", "page", F.lit(None).cast("int").alias("block_ix"), F.col("ix").alias("table_ix"), F.lit(None).cast("int").alias("figure_ix")))
    figures = h.where("kind = 'figure'").join(cap.withColumnRenamed("figure_ix", "ix"), ["doc_id", "ix"]).select("doc_id", "seq", "above", "kind", F.col("f_page").alias("page"), *_none("block_ix", "table_ix"), F.col("ix").alias("figure_ix"))
    leaves = written(leaves.unionByName(figures), "leaves")
    full = leaves.select("doc_id", F.explode("above").alias("seq"), "page").groupBy("doc_id", "seq").agg(F.min("page").alias("page"))
    sections = h.where("kind = 'section'").join(full, ["doc_id", "seq"]).select("doc_id", "seq", "above", "kind", "page", *_none("block_ix", "table_ix", "figure_ix"))
    told = leaves.unionByName(sections).select(*_NODE, F.lit(0).alias("tier"))
    # a caption stands behind its figure's seq; all seqs are doubled to make room
    told = told.withColumns({"seq": F.col("seq") * 2, "above": F.transform("above", lambda x: x * 2)})
    under = own.join(told.where("kind = 'figure'").select("doc_id", "figure_ix", "seq", "above"), ["doc_id", "figure_ix"])
    under = under.select("doc_id", (F.col("seq") + 1).alias("seq"), F.concat("above", F.array("seq")).alias("above"), F.lit("caption").alias("kind"), "page", "block_ix", *_none("table_ix", "figure_ix"), F.lit(0).alias("tier"))
    told = written(told.unionByName(under), "told")
    claimed = told.select("doc_id", "block_ix", "table_ix")
    rest_b = flow.join(claimed.where("block_ix IS NOT NULL"), ["doc_id", "block_ix"], "left_anti").select("doc_id", F.lit(0).alias("rank"), F.col("block_ix").alias("ix"), F.col("leaf").alias("kind"), "page", "block_ix", *_none("table_ix"))
    rest_t = t.join(claimed.where("table_ix IS NOT NULL"), ["doc_id", "table_ix"], "left_anti").select("doc_id", F.lit(1).alias("rank"), F.col("table_ix").alias("ix"), F.lit("table").alias("kind"), "page", *_none("block_ix"), "table_ix")
    rest = rest_b.unionByName(rest_t)
    far = F.lit(1 << 30)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "rank", "ix"))
    rest = rest.select("doc_id", (far + nth).alias("seq"), F.array(F.lit(0)).alias("above"), "kind", "page", "block_ix", "table_ix", F.lit(None).cast("int").alias("figure_ix"), F.lit(3).alias("tier"))
    body = told.unionByName(rest).withColumn("top", F.when(F.size("above") > 1, F.col("above")[1]).otherwise(F.col("seq")))
    top = body.where("seq = top").groupBy("doc_id", "top").agg(F.min(F.struct("page", "tier", "seq")).alias("o"))
    body = body.join(top, ["doc_id", "top"])
    head = p.select("doc_id").distinct()
    fixed = lambda kind, seq, above, tier: head.select("doc_id", F.lit(seq).alias("seq"), above.alias("above"), F.lit(kind).alias("kind"), F.lit(1).alias("page"), *_none("block_ix", "table_ix", "figure_ix"), F.struct(F.lit(0).alias("page"), F.lit(tier).alias("tier"), F.lit(seq).alias("seq")).alias("o"))
    none = F.array().cast("array<int>")
    last = (1 << 30) - 1
    furn = b.where("zone = 'furniture'").select("doc_id", "block_ix", "page", "role")
    rank = F.coalesce(*(F.when(F.col("role") == k, F.lit(v)) for k, v in (("pageHeader", 0), ("pageNumber", 1), ("pageFooter", 2))), F.lit(3))
    furn = furn.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", rank, "block_ix")))
    tail = F.struct(F.lit((1 << 31) - 1).alias("page"), F.lit(0).alias("tier"), F.lit(last).alias("seq"))
    furniture = furn.select("doc_id", (F.lit(last) - 1 - F.col("n")).alias("seq"), F.array(F.lit(last)).alias("above"), F.lit("paragraph").alias("kind"), "page", "block_ix", *_none("table_ix", "figure_ix"), tail.alias("o"), F.col("n").alias("walk"))
    all_ = (
        fixed("document", -2, none, -2)
        .unionByName(fixed("body", 0, F.array(F.lit(-2)), -1))
        .unionByName(body.select(*_NODE, "o").withColumn("above", F.concat(F.array(F.lit(-2)), "above")))
        .unionByName(head.select("doc_id", F.lit(last).alias("seq"), F.array(F.lit(-2)).alias("above"), F.lit("furniture").alias("kind"), F.lit(1).alias("page"), *_none("block_ix", "table_ix", "figure_ix"), tail.alias("o")))
        .withColumn("walk", F.when(F.col("kind") == "furniture", 0).otherwise(F.col("seq")))
        .unionByName(furniture.withColumn("above", F.array(F.lit(-2), F.lit(last))))
    )
    nodes = all_.withColumn("id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "walk")) - 1).cast("long"))
    return paths(written(nodes.drop("o", "walk"), "nodes"))


def paths(nodes: DataFrame) -> DataFrame:
    """Nodes (doc_id, id, seq, above, kind, ...) with parent and path: the tokens of all nodes above, siblings of a kind counted."""
    kinds = {**patch.TOKENS, "document": "doc", "furniture": "furn", "caption": "cap"}
    token = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()), F.col("kind"))
    up = F.try_element_at("above", F.lit(-1))
    w = Window.partitionBy("doc_id", up, token).orderBy("id")
    n = nodes.withColumn("token", F.when(up.isNull(), token).otherwise(F.concat(token, F.lit("["), F.row_number().over(w).cast("string"), F.lit("]"))))
    n = written(n, "tokens")
    names = n.select("doc_id", F.col("seq").alias("a"), F.col("token").alias("a_token"), F.col("id").alias("a_id"))
    chain = n.select("doc_id", "id", F.posexplode("above").alias("i", "a")).join(names, ["doc_id", "a"])
    chain = chain.groupBy("doc_id", "id").agg(F.array_sort(F.collect_list(F.struct("i", "a_token", "a_id"))).alias("c"))
    out = n.join(chain, ["doc_id", "id"], "left")
    tokens = F.concat(F.coalesce(F.transform("c", lambda x: x["a_token"]), F.array().cast("array<string>")), F.array("token"))
    return out.select("doc_id", "id", F.try_element_at("c", F.lit(-1))["a_id"].alias("parent"), "kind", F.concat(F.lit("//"), F.array_join(tokens, "/")).alias("path"), "page", "block_ix", "table_ix", "figure_ix")


def report(tree: DataFrame) -> DataFrame:
    """(doc_id, nodes, sections, depth, body_leaves, figures, tables) of trees."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    deep = F.max(F.size(F.split("path", "/")) - 2)
    return tree.groupBy("doc_id").agg(F.count("*").alias("nodes"), kind("section").alias("sections"), deep.cast("long").alias("depth"), F.count("block_ix").alias("blocks"), kind("figure").alias("figures"), kind("table").alias("tables"))



def tree_markdown(tree: DataFrame, elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, elements, markdown) of trees: their leaves in reading order, each under an anchor with its path, headings by how many
    sections they are in, a page's marker where the page is first met; furniture comes after everything else. elements: from
    ``emit.view_elements``; pages: doc_id, page, width, height, unit."""
    leaf = tree.where("block_ix IS NOT NULL OR table_ix IS NOT NULL").withColumn("e_kind", F.when(F.col("block_ix").isNotNull(), 3).otherwise(0)).withColumn("ix", F.coalesce("block_ix", "table_ix"))
    e = leaf.drop("kind").join(elements.withColumnRenamed("kind", "e_kind").drop("page", "y"), ["doc_id", "e_kind", "ix"])
    depth = F.size(F.filter(F.split("path", "/"), lambda t: t.startswith("sect")))
    own = F.regexp_extract("md", r"(?s)^## (.*)$", 1)
    md = F.when((F.col("e_kind") == 3) & F.col("md").startswith("## "), F.concat(F.repeat(F.lit("#"), 1 + F.least(F.greatest(depth, F.lit(1)), F.lit(5))), F.lit(" "), own)).otherwise(F.col("md"))
    anchor = F.regexp_replace("anchor", " -->$", F.concat(F.lit(" path="), F.regexp_replace("path", r"\\", ""), F.lit(" -->")))
    info = pages.withColumn("_s", emit.page_scale(F.col("unit")))
    marker = info.select("doc_id", "page", T.page_marker(F.col("page"), F.col("width") * F.col("_s"), F.col("height") * F.col("_s"), F.col("unit"), F.col("_s")).alias("marker"))
    first = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("id")) == 1
    e = e.withColumns({"md": md, "anchor": anchor, "_first": first}).join(marker, ["doc_id", "page"], "left")
    shown = F.concat_ws("\n", "anchor", "md")
    text = F.when(F.col("_first"), F.concat_ws("\n\n", F.coalesce("marker", T.page_marker(F.col("page"))), shown)).otherwise(shown)
    d = e.groupBy("doc_id").agg(F.count("*").alias("elements"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    front = emit.front_matter({"format": F.lit("inkfold-tree/1"), "generator": F.lit("inkfold"), "doc_id": F.col("doc_id"), "elements": F.col("elements")})
    return d.select("doc_id", "elements", F.concat(front, T.rstrip(F.col("body")), F.lit("\n")).alias("markdown"))
