"""Recognised layouts (JSON) as long tables, by tolerant native parsing: wrong types become defaults, never errors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions import geometry as G
from ..functions import text as T

# Roles that name a zone.
ZONES = {"title": "title", "sectionHeading": "heading", "pageHeader": "furniture", "pageFooter": "furniture", "pageNumber": "furniture"}

_POLY = "array<double>"
_REGIONS = f"array<struct<pageNumber:int,polygon:{_POLY}>>"
_SPANS = "array<struct<offset:bigint,length:bigint>>"
_SPAN = "span:struct<offset:bigint,length:bigint>"
_NODE = f"content:string,text:string,boundingRegions:{_REGIONS}"
_LINE = f"content:string,text:string,polygon:{_POLY},boundingBox:{_POLY},bbox:{_POLY},spans:{_SPANS}"
_CELL = f"struct<kind:string,cell_kind:string,rowIndex:int,row_index:int,columnIndex:int,column_index:int,rowSpan:int,row_span:int,columnSpan:int,column_span:int,{_NODE},bbox:{_POLY},spans:{_SPANS}>"
_PAGE = f"pageNumber:int,width:double,height:double,unit:string,angle:double,selectionMarks:array<struct<state:string,polygon:{_POLY}>>,lines:array<struct<{_LINE}>>"
_READ_PAGE = f"page:int,pageNumber:int,width:double,height:double,unit:string,angle:double,language:string,lines:array<struct<{_LINE}>>"
#: Lists of a layout and what is in them.
LISTS = {
    "pages": f"struct<{_PAGE}>",
    "paragraphs": f"struct<{_NODE},role:string,spans:{_SPANS},{_SPAN}>",
    "tables": f"struct<table_id:string,rowCount:int,columnCount:int,{_NODE},spans:{_SPANS},{_SPAN},cells:array<{_CELL}>>",
    "sections": f"struct<elements:array<string>,spans:{_SPANS}>",
    "figures": f"struct<id:string,elements:array<string>,{_NODE},caption:struct<elements:array<string>,{_NODE},spans:{_SPANS},{_SPAN}>>",
    "selectionMarks": f"struct<state:string,boundingRegions:{_REGIONS}>",
    "keyValuePairs": f"struct<key:struct<{_NODE}>,value:struct<{_NODE}>,confidence:double>",
    "languages": "struct<locale:string>",
    "readResults": f"struct<{_READ_PAGE}>",
}
#: What `marks` and `captions` need of them.
MARKS = {"pages": f"struct<pageNumber:int,selectionMarks:array<struct<state:string,polygon:{_POLY}>>>", "selectionMarks": LISTS["selectionMarks"]}
CAPTIONS = {"paragraphs": f"struct<spans:{_SPANS},{_SPAN}>", "figures": LISTS["figures"]}


def _lists(kind: DataType) -> bool:
    """Whether a list of objects is in it."""
    if isinstance(kind, ArrayType):
        return isinstance(kind.elementType, StructType)
    return isinstance(kind, StructType) and any(_lists(f.dataType) for f in kind)


def _kept(x: Column, kind: DataType) -> Column:
    """What was read as the type, less what stood in lists of objects and was none: it was read as null."""
    if not _lists(kind):
        return x
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*(_kept(x[f.name], f.dataType).alias(f.name) for f in kind)))
    objects = F.filter(x, lambda e: e.isNotNull())
    return F.transform(objects, lambda e: _kept(e, kind.elementType)) if _lists(kind.elementType) else objects


def parsed(docs: DataFrame, json: str = "json", lists: dict[str, str] = LISTS) -> DataFrame:
    """Adds doc (the layout, whichever wrapper it came in) and shape: read or layout. What is not an object in a list is dropped, a
    field of the wrong type is null, and malformed JSON gives nulls throughout: nothing raises, and no field spoils another. A caller
    who needs some lists only, or some fields of what is in them, names those: doc has no others, and all their entries."""
    d = docs.withColumn("_v", F.try_parse_json(F.col(json)))
    d = d.withColumn("_v", F.coalesce(F.try_variant_get("_v", "$.analyzeResult", "variant"), F.col("_v")))
    kinds = {**dict.fromkeys(("apiVersion", "modelId", "content", "version"), "string"), **{k: f"array<{t}>" for k, t in ({"readResults": "struct<page:int>"} | lists).items()}}
    kind = StructType.fromDDL(",".join(f"{k} {t}" for k, t in kinds.items()))
    # one walk through the variant: read field by field, its parts are copied, and their types worked out, once more for each level
    d = d.withColumn("_v", F.try_variant_get("_v", "$", kind.simpleString()))
    d = d.withColumn("doc", F.struct(*(_kept(F.col("_v")[f.name], f.dataType).alias(f.name) for f in kind))).drop("_v")
    return d.withColumn("shape", F.when(F.coalesce(F.size("doc.readResults"), F.lit(0)) > 0, "read").otherwise("layout"))


def _spans_of(n: Column) -> Column:
    """Spans with an offset of zero or more, stated as a list or as one."""
    both = F.coalesce(F.when(F.size(n["spans"]) > 0, n["spans"]), F.when(n["span"].isNotNull(), F.array(n["span"])))
    return F.filter(both, lambda s: s["offset"] >= 0)


def _text(n: Column) -> Column:
    return F.coalesce(F.nullif(n["content"], F.lit("")), n["text"], F.lit(""))


def _page(n: Column) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(n["boundingRegions"], F.lit(1))["pageNumber"], F.lit(0)), F.lit(1))


def _quad(n: Column) -> Column:
    return G.quad(F.try_element_at(n["boundingRegions"], F.lit(1))["polygon"])


def pages(p: DataFrame) -> DataFrame:
    """(doc_id, page, width, height, unit, angle)"""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lay = p.where("shape = 'layout'").select("doc_id", F.posexplode("doc.pages").alias("i", "n")).select("doc_id", "i", F.col("n.pageNumber").alias("no"), *(F.col(f"n.{c}").alias(c) for c in ("width", "height", "unit", "angle")))
    read = p.where("shape = 'read'").select("doc_id", F.posexplode("doc.readResults").alias("i", "n")).select("doc_id", "i", F.coalesce("n.page", "n.pageNumber").alias("no"), *(F.col(f"n.{c}").alias(c) for c in ("width", "height", "unit", "angle")))
    both = lay.unionByName(read)
    no = F.when(F.coalesce("no", F.lit(0)) > 0, F.col("no")).otherwise(F.col("i") + 1)
    return both.select("doc_id", no.alias("page"), zero("width").alias("width"), zero("height").alias("height"), F.coalesce("unit", F.lit("pixel")).alias("unit"), zero("angle").alias("angle"))


def blocks(p: DataFrame) -> DataFrame:
    """(doc_id, block_ix, node_ix, page, text, role, zone, quad, spans): paragraphs, or lines where there are none, node_ix being their
    place among them; zones by role, by overlap with a table's spans, by a centre inside its rectangle."""
    lay = p.where("shape = 'layout'")
    para = lay.select("doc_id", F.posexplode("doc.paragraphs").alias("i", "n")).select("doc_id", "i", _page(F.col("n")).alias("page"), T.strip(_text(F.col("n"))).alias("text"), "n.role", _quad(F.col("n")).alias("quad"), _spans_of(F.col("n")).alias("spans"))
    bare = lay.where(F.coalesce(F.size("doc.paragraphs"), F.lit(0)) <= 0).select("doc_id", F.posexplode("doc.pages").alias("pi", "g"))
    line = bare.select("doc_id", "pi", F.coalesce(F.nullif(F.col("g.pageNumber"), F.lit(0)), F.col("pi") + 1).alias("page"), F.posexplode("g.lines").alias("li", "n"))
    line = line.select("doc_id", (F.col("pi") * 1_000_000 + F.col("li")).alias("i"), "page", T.strip(_text(F.col("n"))).alias("text"), F.lit(None).cast("string").alias("role"), G.quad(F.col("n.polygon")).alias("quad"), F.col("n.spans").alias("spans"))
    read = p.where("shape = 'read'").select("doc_id", F.posexplode("doc.readResults").alias("pi", "g")).select("doc_id", "pi", F.coalesce("g.page", "g.pageNumber", F.col("pi") + 1).alias("page"), F.posexplode("g.lines").alias("li", "n"))
    read = read.select("doc_id", (F.col("pi") * 1_000_000 + F.col("li")).alias("i"), "page", T.strip(_text(F.col("n"))).alias("text"), F.lit(None).cast("string").alias("role"), G.quad(F.col("n.boundingBox")).alias("quad"), F.lit(None).cast(_SPANS).alias("spans"))
    b = para.unionByName(line).unionByName(read).where("text <> ''")
    b = b.withColumn("block_ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1)
    t = p.select("doc_id", F.explode("doc.tables").alias("n"))
    t = t.select("doc_id", _page(F.col("n")).alias("page"), F.flatten(F.array(F.coalesce("n.spans", F.array().cast(_SPANS)))).alias("s"), F.flatten(F.coalesce(F.transform("n.cells", lambda c: F.coalesce(c["spans"], F.array().cast(_SPANS))), F.array().cast(f"array<{_SPANS}>"))).alias("cs"), F.filter(F.transform("n.cells", _quad), lambda q: q.isNotNull()).alias("cq"), _quad(F.col("n")).alias("tq"))
    t = t.select("doc_id", "page", F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("cs")).alias("s"), F.when(F.size("cq") > 0, F.col("cq")).when(F.col("tq").isNotNull(), F.array("tq")).otherwise(F.array().cast("array<array<double>>")).alias("q"))
    t = t.groupBy("doc_id", "page").agg(F.flatten(F.collect_list("s")).alias("t_spans"), F.flatten(F.collect_list("q")).alias("t_quads"))
    j = b.join(t, ["doc_id", "page"], "left")
    over = F.exists("spans", lambda a: F.exists("t_spans", lambda s: G.spans_overlap(a["offset"], a["length"], s["offset"], s["length"])))
    mid = lambda k: (F.col("quad")[k] + F.col("quad")[k + 2] + F.col("quad")[k + 4] + F.col("quad")[k + 6]) / 4
    xs = lambda q, k: F.array(q[k], q[k + 2], q[k + 4], q[k + 6])
    inside = F.exists("t_quads", lambda q: (mid(0) >= F.array_min(xs(q, 0))) & (mid(0) <= F.array_max(xs(q, 0))) & (mid(1) >= F.array_min(xs(q, 1))) & (mid(1) <= F.array_max(xs(q, 1))))
    zone = F.coalesce(*(F.when(F.col("role") == k, F.lit(v)) for k, v in ZONES.items()), F.when(F.coalesce(over, F.lit(False)) | F.coalesce(F.when(F.col("quad").isNotNull(), inside), F.lit(False)), F.lit("table")), F.lit("body"))
    zone = F.when(F.col("shape_") == "read", F.lit("body")).otherwise(zone)
    j = j.join(p.select("doc_id", F.col("shape").alias("shape_")), "doc_id")
    return j.select("doc_id", "block_ix", F.col("i").cast("long").alias("node_ix"), "page", "text", "role", zone.alias("zone"), "quad", "spans")


def tables(p: DataFrame) -> DataFrame:
    """(doc_id, table_ix, table_id, page, quad, row_count, col_count, cells): counts from the cells where none are stated."""
    t = p.select("doc_id", F.posexplode("doc.tables").alias("table_ix", "n"))
    first = lambda c, *names: F.coalesce(*(c[n] for n in names))
    cell = lambda c: F.struct(
        F.coalesce(first(c, "rowIndex", "row_index"), F.lit(0)).alias("row"),
        F.coalesce(first(c, "columnIndex", "column_index"), F.lit(0)).alias("col"),
        F.greatest(F.lit(1), F.coalesce(first(c, "rowSpan", "row_span"), F.lit(1))).alias("row_span"),
        F.greatest(F.lit(1), F.coalesce(first(c, "columnSpan", "column_span"), F.lit(1))).alias("col_span"),
        T.strip(F.replace(_text(c), F.lit("\n"), F.lit(" "))).alias("text"),
        F.coalesce(c["kind"], c["cell_kind"], F.lit("content")).isin("columnHeader", "rowHeader").alias("is_header"),
    )
    t = t.select("doc_id", "table_ix", F.col("n.table_id").alias("stated"), _page(F.col("n")).alias("page"), _quad(F.col("n")).alias("quad"), F.col("n.rowCount").alias("rc"), F.col("n.columnCount").alias("cc"), F.coalesce(F.transform("n.cells", cell), F.array().cast("array<struct<row:int,col:int,row_span:int,col_span:int,text:string,is_header:boolean>>")).alias("cells"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("table_ix")) - 1
    reach = lambda a, b: F.coalesce(F.array_max(F.transform("cells", lambda c: c[a] + c[b])), F.lit(0))
    t = t.withColumn("nth", nth)
    return t.select(
        "doc_id", "table_ix", F.coalesce("stated", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-tbl"), F.col("nth").cast("string"))).alias("table_id"), "page", "quad",
        F.coalesce(F.nullif("rc", F.lit(0)), reach("row", "row_span")).alias("row_count"), F.coalesce(F.nullif("cc", F.lit(0)), reach("col", "col_span")).alias("col_count"), "cells",
    )


def marks(p: DataFrame) -> DataFrame:
    """(doc_id, mark_ix, page, state, quad) from the pages, then from the top level."""
    on = p.select("doc_id", F.posexplode("doc.pages").alias("pi", "g")).select("doc_id", "pi", F.coalesce(F.nullif(F.col("g.pageNumber"), F.lit(0)), F.col("pi") + 1).alias("page"), F.posexplode("g.selectionMarks").alias("mi", "n"))
    on = on.select("doc_id", "pi", "mi", "page", F.coalesce("n.state", F.lit("unselected")).alias("state"), G.quad(F.col("n.polygon")).alias("quad"))
    top = p.select("doc_id", F.lit(1 << 30).alias("pi"), F.posexplode("doc.selectionMarks").alias("mi", "n")).select("doc_id", "pi", "mi", _page(F.col("n")).alias("page"), F.coalesce("n.state", F.lit("unselected")).alias("state"), _quad(F.col("n")).alias("quad"))
    both = on.unionByName(top)
    return both.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pi", "mi")) - 1).alias("mark_ix"), "page", "state", "quad")


def key_values(p: DataFrame) -> DataFrame:
    """(doc_id, kv_ix, key, value, page, key_quad, value_quad, confidence); pairs without a key are dropped."""
    k = p.select("doc_id", F.posexplode("doc.keyValuePairs").alias("i", "n"))
    k = k.select("doc_id", "i", T.strip(_text(F.col("n.key"))).alias("key"), F.coalesce(T.strip(_text(F.col("n.value"))), F.lit("")).alias("value"), _page(F.col("n.key")).alias("page"), _quad(F.col("n.key")).alias("key_quad"), _quad(F.col("n.value")).alias("value_quad"), "n.confidence")
    return k.where("key <> ''").withColumn("kv_ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).drop("i")


def languages(p: DataFrame) -> DataFrame:
    """Distinct locales in the order they are first stated."""
    said = F.when(F.col("shape") == "read", F.transform("doc.readResults", lambda r: r["language"])).otherwise(F.transform("doc.languages", lambda x: x["locale"]))
    return p.select("doc_id", F.array_distinct(F.filter(F.transform(said, lambda x: T.strip(x)), lambda x: x.isNotNull() & (x != ""))).alias("languages"))


def attached_lines(p: DataFrame) -> DataFrame:
    """(doc_id, block_ix, line_ix, page, text, quad): lines of layouts joined to the block of which any span meets any of theirs, the
    one that begins first if several do."""
    from ..operators.joins import span_join

    ln = p.where("shape = 'layout'").select("doc_id", F.posexplode("doc.pages").alias("pi", "g")).select("doc_id", "pi", F.coalesce(F.nullif(F.col("g.pageNumber"), F.lit(0)), F.col("pi") + 1).alias("page"), F.posexplode("g.lines").alias("li", "n"))
    ln = ln.select("doc_id", (F.col("pi") * 1_000_000 + F.col("li")).alias("line_ix"), "page", T.strip(_text(F.col("n"))).alias("text"), G.quad(F.col("n.polygon")).alias("quad"), F.filter("n.spans", lambda s: s["offset"] >= 0).alias("spans")).where("text <> ''")
    each = lambda d, *names: d.select(*names, F.explode("spans").alias("s")).select(*names, F.col("s.offset").alias("off"), F.coalesce("s.length", F.lit(0).cast("long")).alias("len"))
    b = blocks(p).where("zone <> 'table'").withColumn("low", F.array_min(F.transform("spans", lambda s: s["offset"])))
    hit = span_join(each(ln, "doc_id", "line_ix"), each(b, "doc_id", "block_ix", "low"))
    return ln.drop("spans").join(hit, ["doc_id", "line_ix"]).select("doc_id", "block_ix", "line_ix", "page", "text", "quad")


# What a reference's first word points to.
REFERENCES = {"paragraphs": "paragraph", "sections": "section", "tables": "table", "figures": "figure"}
_REFS = "array<struct<kind:string,ix:int>>"


def references(elements: Column) -> Column:
    """References of the form /paragraphs/3 as kinds and numbers; others have no kind."""
    part = lambda e, i: F.regexp_extract(e, r"\A/([a-z]+)/([0-9]{1,9})\z", i)
    kind = lambda e: F.coalesce(*(F.when(part(e, 1) == k, F.lit(v)) for k, v in REFERENCES.items()))
    return F.transform(elements, lambda e: F.struct(kind(e).alias("kind"), F.when(part(e, 2) != "", part(e, 2)).cast("int").alias("ix")))


def harvest(p: DataFrame) -> DataFrame:
    """(doc_id, seq, section_ix, above, depth, kind, ix, dangling, double_claims, cycles_cut): the elements of all sections in
    document order, each with the seq of all sections above it, which is the order of a walk from section 0 through the references as they stand. What points nowhere is dropped,
    an element keeps its first section, a section met again is not entered; how often each happened stands in every row of a document.
    A document with sections has at least its root, kind section, seq 0. Sequential within a document, so it is walked in Arrow batches."""
    size = lambda n: F.coalesce(F.greatest(F.size(f"doc.{n}"), F.lit(0)), F.lit(0)).alias(n)
    refs = F.transform("doc.sections", lambda s: F.coalesce(references(s["elements"]), F.array().cast(_REFS)))
    src = p.where(F.size("doc.sections") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), refs.alias("sections"), *(size(n) for n in REFERENCES if n != "sections"))
    names = ["doc_id", "seq", "section_ix", "above", "depth", "kind", "ix", "dangling", "double_claims", "cycles_cut"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def walk(sections: list, most: dict[str, int]) -> tuple[list[tuple], list[int]]:
        out: list[tuple] = [(0, None, [], 0, "section", 0)]
        claimed = {("section", 0)}
        faults = [0, 0, 0]
        path = [(0, 0, iter(sections[0]))]  # seq and number of each open section, and what is left of it
        while path:
            _, number, rest = path[-1]
            ref = next(rest, None)
            if ref is None:
                path.pop()
                continue
            key = (ref["kind"], ref["ix"])
            if key[0] is None or key[1] is None or key[1] >= most[key[0]]:
                faults[0] += 1
            elif key in claimed:
                faults[2 if key[0] == "section" else 1] += 1
            else:
                claimed.add(key)
                seq = len(out)
                out.append((seq, number, [s for s, _, _ in path], len(path), *key))
                if key[0] == "section":
                    path.append((seq, key[1], iter(sections[key[1]])))
        return out, faults

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, sections, *sizes in zip(*(c.to_pylist() for c in b.columns)):
                most = dict(zip((v for k, v in REFERENCES.items() if k != "sections"), sizes)) | {"section": len(sections)}
                found, faults = walk(sections, most)
                rows += [(doc, *f, *faults) for f in found]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return src.mapInArrow(go, "doc_id long, seq int, section_ix int, above array<int>, depth int, kind string, ix int, dangling int, double_claims int, cycles_cut int")


def captions(p: DataFrame) -> DataFrame:
    """(doc_id, figure_ix, page, quad, paragraph_ix): the paragraph that is a figure's caption, by the caption's own reference, else the
    first whose spans meet the caption's, else null."""
    f = p.select("doc_id", F.posexplode("doc.figures").alias("figure_ix", "n"), F.size("doc.paragraphs").alias("many"), F.transform("doc.paragraphs", _spans_of).alias("spans"))
    own = F.filter(references(F.col("n.caption.elements")), lambda r: (r["kind"] == "paragraph") & (r["ix"] < F.col("many")))
    f = f.select("doc_id", "figure_ix", _page(F.col("n")).alias("page"), _quad(F.col("n")).alias("quad"), F.try_element_at(own, F.lit(1))["ix"].alias("own"), _spans_of(F.col("n.caption")).alias("said"), "spans")
    meets = lambda a: F.exists("said", lambda c: F.exists(a, lambda s: G.spans_overlap(c["offset"], c["length"], s["offset"], s["length"])))
    met = F.array_min(F.transform("spans", lambda a, i: F.when(meets(a), i)))
    return f.select("doc_id", "figure_ix", "page", "quad", F.coalesce("own", met).alias("paragraph_ix"))


def envelopes(docs: DataFrame, json: str = "json") -> DataFrame:
    """Pages of enveloped results ({page, raw}, {pages: [...]}, or a bare page) as layouts of their own: doc_id, page, json, with the
    page number of the envelope; the verbatim payload is preferred. ``parsed`` reads the result."""
    page = "struct<page_number:int,pageNumber:int,page:int>"
    e = docs.select("doc_id", F.col(json).alias("j"), F.from_json(json, "struct<pages:array<string>>").alias("o"))
    many = F.when(F.col("o.pages").isNotNull(), F.col("o.pages")).otherwise(F.array("j"))
    e = e.select("doc_id", F.posexplode(many).alias("i", "e"))
    e = e.select("doc_id", "i", "e", F.from_json("e", "struct<page:string,raw:string>").alias("x"))
    meta = F.when(F.col("x.page").startswith("{"), F.col("x.page")).otherwise(F.col("e"))
    e = e.withColumn("meta", meta).withColumn("m", F.from_json("meta", page))
    no = F.greatest(F.coalesce("m.page_number", "m.pageNumber", "m.page", F.lit(1)), F.lit(1))
    body = F.coalesce(F.col("x.raw"), F.col("meta"))
    return e.select("doc_id", no.alias("page"), F.concat(F.lit('{"pages":['), body, F.lit("]}")).alias("json"), body.alias("payload"))
