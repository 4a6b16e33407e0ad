"""Golden documents, edge cases and invariants of operators that SQL cannot check."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from inkfold.functions import geometry as G
from inkfold.functions import text as T
from inkfold.operators import bands, canvas, joins, patch
from inkfold.plans import catalogue_layout
from inkfold.sources import catalog, html, media, provider, texts, xlsx
from inkfold.streaming import ingest


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_text_functions(spark):
    df = col(spark, ["　a\tb ", "x<!--y|\nz", "", "Said “so.”) ", "end-", "日本é"])
    got = df.select(T.strip(F.col("v")), T.cell(F.col("v")), T.ends_terminal(F.col("v")), T.ends_hyphen(F.col("v")), T.cell_width(F.col("v")), T.script_class(F.col("v"))).collect()
    assert got[0][0] == "a\tb" and got[1][1] == "x<! --y\\|<br>z"
    assert [r[2] for r in got] == [False, False, False, True, False, False] and got[4][3]
    assert got[5][4] == 5 and got[5][5] == "mixed" and got[2][5] == "none"


def test_lines_and_pages(spark):
    df = col(spark, ["a\r\nb c\n", "", "\n", "\t1\fx" + "y" * 100, "\n" * 60, None]).withColumnRenamed("i", "doc_id").withColumnRenamed("v", "text")
    got = {}
    for r in texts.wrap_pages(df).collect():
        got.setdefault(r["doc_id"], []).append((r["page"], r["row"], r["text"]))
    assert got[0] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")] and got[2] == [(1, 0, "")] and 1 not in got and 5 not in got
    assert got[3] == [(1, 0, "        1"), (2, 0, "x" + "y" * 77), (2, 1, "y" * 23)]
    assert [x[0] for x in got[4]] == [1] * 54 + [2] * 6


def test_geometry(spark):
    q = spark.createDataFrame([([0.5, 1.5, 2.5, 3.5],), ([1.0] * 8,), ([1.0, 2.0, 5.0, 9.0, 3.0, 4.0],), ([1.0, 2.0],), (None,)], "p array<double>")
    got = q.select(G.rect(G.quad(F.col("p"))).alias("r"), G.rect(G.quad(F.col("p")), 1000).alias("m")).collect()
    assert tuple(got[0]["r"]) == (0, 2, 2, 4) and tuple(got[0]["m"]) == (500, 1500, 2500, 3500)
    assert tuple(got[2]["r"]) == (1, 2, 5, 9) and got[3]["r"] is None and got[4]["r"] is None
    assert spark.range(1).select(G.floordiv(F.lit(-7), 2), G.mu(F.lit(-0.0005))).first()[:2] == (-4, 0)


PAGE = """<html lang="en"><head><title>no</title><style>p{}</style></head><body><h1>One &amp; two</h1><h1>Three</h1>
<p>plain  <b>bold</b></p><p><b>All bold</b></p><ul><li>item</li></ul><div style="display:none">gone<p>gone</p></div>
<table><tr><th colspan=2>H</th><th>I</th></tr><tr><td rowspan="2">a<br>b</td><td>c</td><td><table><tr><td>n</td><td>m</td></tr></table></td></tr><tr><td>d</td></tr></table>
<table><tr><td> </td></tr></table>tail<script>var x = "</p>";</script></body>"""


def test_html(spark):
    got = html.html_blocks(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).orderBy("seq").collect()
    text = [(r["text"], r["zone"], r["role"]) for r in got if r["kind"] == "block"]
    assert text == [("One & two", "title", "h1"), ("Three", "heading", "h1"), ("plain bold", "body", "p"), ("All bold", "heading", "p"), ("- item", "body", "li"), ("tail", "body", None)]
    t = [r for r in got if r["kind"] == "table"]
    assert len(t) == 1 and (t[0]["rows"], t[0]["cols"], t[0]["seq"]) == (3, 3, 5)
    assert [(c["row"], c["col"], c["text"]) for c in t[0]["cells"]] == [(0, 0, "H"), (0, 2, "I"), (1, 0, "a\nb"), (1, 1, "c"), (1, 2, "n m"), (2, 1, "d")]
    assert html.decode(b"<meta charset=latin-1>\xe9") == "<meta charset=latin-1>é"


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k.replace("__", "/"), v)
    return out.getvalue()


def test_media(spark):
    word = zipped(word__document="x")
    rows = [(b"junk%PDF-1.4", None), (b"\x89PNG\r\n\x1a\n", "a.txt"), (b"BMW Finance", None), (b"BM" + bytes(12) + b"\x28\0\0\0" + bytes(20), None), (b"GIF89a", None), (b"<html>", None), (b"a,b", "x.csv"), (b"From: a\nTo: b\n\nhi", None), (b"From: a\nTo: b\n\nhi", "x.csv"), (b"\xff\x00\x01", None), (b"\x00\x01", "x.docx"), (word, None), (b"hello", "x.pdf"), (b"", None), (None, None)]
    df = media.ooxml_kinds(spark.createDataFrame(rows, "content binary, name string"))
    got = [r["k"] for r in df.select(media.classify(F.col("content"), F.col("name"), F.col("package"))["kind"].alias("k")).collect()]
    assert got[:14] == ["pdf", "image", "text", "image", "other", "html", "text", "email", "text", "other", "docx", "docx", "text", "text"]
    body = media.mail_bodies(spark.createDataFrame([(1, b"Subject: x\nContent-Type: text/plain\n\nhello\n")], "id long, content binary")).first()
    assert body["body"].strip() == "hello"


def test_xlsx(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = {
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="Register" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>Name</t></si><si><t>Qty</t></si></sst>",
        "xl/worksheets/sheet1.xml": f"""<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>
          <row r="2"><c r="A2" t="inlineStr"><is><t>widget</t></is></c><c r="B2"><v>3.0</v></c><c r="C2" s="1"><v>45296</v></c><c r="D2"/></row><row r="3"><c r="A3" t="b"><v>1</v></c></row>
          <row r="700"><c r="A700"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B4"/></mergeCells></worksheet>""",
    }
    s = xlsx.sheets(spark.createDataFrame([(1, zipped(**{k: v for k, v in book.items()})), (2, b"no")], "id long, content binary"))
    assert {r["id"]: r["status"] for r in s.collect()} == {1: "ok", 2: "BadZipFile"}
    got = xlsx.tables(s).orderBy("row", "col").collect()
    assert {(r["row"], r["col"]): r["text"] for r in got if r["text"]} == {(0, 0): "Name", (0, 1): "Qty", (1, 0): "widget", (1, 1): "3", (1, 2): "2024-01-05", (2, 0): "TRUE"}
    assert (got[0]["row_count"], got[0]["col_count"], got[0]["truncated"]) == (4, 3, True)
    assert [(r["row_span"], r["col_span"]) for r in got if (r["row"], r["col"]) == (2, 0)] == [(2, 2)] and not any((r["row"], r["col"]) == (3, 1) for r in got)


def test_provider(spark):
    box = lambda a, b, c, d: [a, b, c, b, c, d, a, d]
    region = lambda *q: [{"pageNumber": 1, "polygon": box(*q)}]
    body = {
        "apiVersion": "v", "pages": [{"pageNumber": 1, "width": 8.5, "height": 11, "unit": "inch", "selectionMarks": [{"state": "selected", "polygon": box(0, 0, 1, 1)}], "lines": [{"content": "Ti", "polygon": box(0, 0, 1, 1), "spans": [{"offset": 0, "length": 2}]}, {"content": "in", "spans": [{"offset": 9, "length": 2}]}]}],
        "paragraphs": [{"content": " Ti ", "role": "title", "spans": [{"offset": 0, "length": 3}], "boundingRegions": region(0, 0, 1, 1)}, {"content": "cell", "spans": [{"offset": 9, "length": 4}]}, {"content": " "}, {"content": "mid", "boundingRegions": region(5, 5, 6, 6)}],
        "tables": [{"boundingRegions": region(4, 4, 8, 8), "spans": [{"offset": 9, "length": 5}], "cells": [{"kind": "columnHeader", "rowIndex": 0, "columnIndex": 1, "columnSpan": 2, "content": "a\nb"}]}],
        "keyValuePairs": [{"key": {"content": "k:"}, "value": {"content": "v"}, "confidence": 0.5}, {"key": {"content": " "}}], "languages": [{"locale": "en"}, {"locale": "en"}],
    }
    read = {"analyzeResult": {"version": "3.2", "readResults": [{"page": 2, "width": 10, "height": 20, "language": "fr", "lines": [{"text": "bonjour", "boundingBox": box(1, 1, 2, 2)}, {"text": " "}]}]}}
    p = provider.parsed(spark.createDataFrame([(1, json.dumps({"analyzeResult": body})), (2, json.dumps(read)), (3, "{bad"), (4, json.dumps({"pages": "no"}))], "doc_id long, json string"))
    b = {(r["doc_id"], r["block_ix"]): (r["text"], r["zone"], r["page"]) for r in provider.blocks(p).collect()}
    assert b == {(1, 0): ("Ti", "title", 1), (1, 1): ("cell", "table", 1), (1, 2): ("mid", "table", 1), (2, 0): ("bonjour", "body", 2)}
    assert [(r["page"], r["width"], r["unit"]) for r in provider.pages(p).orderBy("doc_id").collect()] == [(1, 8.5, "inch"), (2, 10.0, "pixel")]
    t = provider.tables(p).first()
    assert (t["table_id"], t["row_count"], t["col_count"], t["cells"][0]["text"], t["cells"][0]["is_header"]) == ("p1-tbl0", 1, 3, "a b", True)
    assert [(r["state"], r["page"]) for r in provider.marks(p).collect()] == [("selected", 1)]
    assert [(r["key"], r["value"], r["confidence"]) for r in provider.key_values(p).collect()] == [("k:", "v", 0.5)]
    assert {r["doc_id"]: r["languages"] for r in provider.languages(p).collect() if r["languages"]} == {1: ["en"], 2: ["fr"]}
    assert [(r["block_ix"], r["text"]) for r in provider.attached_lines(p).collect()] == [(0, "Ti")]
    env = spark.createDataFrame([(1, json.dumps({"pages": [{"page": {"page_number": 7}, "raw": {"pageNumber": 1, "lines": []}}, {"page_number": 8, "lines": []}]}))], "doc_id long, json string")
    assert [r["page"] for r in provider.envelopes(env).orderBy("page").collect()] == [7, 8]


def first_fit(atoms, most):
    out, open_ = {}, []
    for ix, y0, x0, y1 in sorted(((a[0], a[1], a[2], a[3]) for a in atoms), key=lambda a: (a[1], a[2], a[0])):
        for k, (s0, s1, n) in enumerate(open_):
            if n < most and 2 * max(0, min(y1, s1) - max(y0, s0)) >= min(y1 - y0, s1 - s0):
                open_[k] = (s0, s1, n + 1)
                break
        else:
            k = len(open_)
            open_.append((y0, y1, 1))
        out[ix] = k
    return out


def test_bands_equal_a_sweep(spark):
    import random

    rng = random.Random(9)
    pages = {p: [(i, rng.randrange(60), rng.randrange(40), 0) for i in range(rng.randrange(1, 30))] for p in range(25)}
    pages = {p: [(i, y, x, y + rng.randrange(1, 12)) for i, y, x, _ in a] for p, a in pages.items()}
    rows = [(p, i, "line", "t", x, y, x + 5, y1) for p, a in pages.items() for i, y, x, y1 in a]
    df = spark.createDataFrame(rows, "page int, atom_ix int, kind string, text string, x0 long, y0 long, x1 long, y1 long")
    for parts in (1, 7):
        got = {(r["page"], r["atom_ix"]): r["band"] for r in bands.bands(df.repartition(parts), ["page"], 3).collect()}
        assert got == {(p, i): b for p, a in pages.items() for i, b in first_fit(a, 3).items()}


def test_canvas(spark):
    a, em, b = catalogue_layout._banded(spark, "/root/testdata/sf0.001")
    k = ["page"]
    f = bands.frames(b, bands.gutters(bands.occupancy(b, em, k), k), em, k)
    lines = canvas.rows(bands.tab_stops(b, f, k), b, f, em, k)
    text = "".join(r["text"] for r in lines.collect())
    assert sorted(text.replace(" ", "")) == sorted("".join(r["text"] for r in a.collect()).replace(" ", ""))
    got = canvas.segments(lines, k).collect()
    assert got and all(r["row_hi"] - r["row_lo"] < 20 for r in got)


def test_span_join_ties(spark):
    lines = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 0), (1, 2, 5000, 10), (1, 3, 90, 2)], "doc_id long, line_ix int, off long, len long")
    blocks = spark.createDataFrame([(1, 3, 0, 6), (1, 1, 0, 5000), (1, 2, 4000, 2000)], "doc_id long, block_ix int, off long, len long")
    assert {r["line_ix"]: r["block_ix"] for r in joins.span_join(lines, blocks).collect()} == {0: 1, 1: 1, 2: 2, 3: 1}


NODES = [(1, 0, None, "doc", 1), (1, 1, 0, "body", 1), (1, 2, 1, "section", 1), (1, 3, 2, "heading", 1), (1, 4, 2, "paragraph", 1), (1, 5, 2, "paragraph", 1), (1, 6, 1, "table", 1), (1, 7, 6, "paragraph", 1), (1, 8, 1, "paragraph", 2)]


def test_patch(spark):
    nodes = spark.createDataFrame(NODES, "doc_id long, id long, parent long, kind string, page int").drop("page")
    ops = lambda *o: spark.createDataFrame([(1, i, *x) for i, x in enumerate(o)], "doc_id long, op_ix long, op string, node string, ref string")
    got = {r["old_id"]: r for r in patch.apply_patches(nodes, ops(("move_before", "//doc/body[1]/p[1]", "//doc/body[1]/sect[1]"), ("merge_flow", "//doc/body[1]/p[1]", "//doc/body[1]/sect[1]/p[2]"))).collect()}
    assert [o for o, _ in sorted(got.items(), key=lambda x: x[1]["id"])] == [0, 1, 8, 5, 2, 3, 4, 6, 7]
    assert got[5]["path"] == "//doc/body[1]/p[2]" and got[4]["path"] == "//doc/body[1]/sect[1]/p[1]" and got[0]["status"] == "ok"
    bad = patch.apply_patches(nodes, ops(("move_after", "//doc/body[1]/p[1]", "//doc/body[1]/sect[1]"), ("reparent", "//doc/body[1]/sect[1]", "//doc/body[1]/sect[1]/h[1]"))).collect()
    assert {r["status"] for r in bad} == {"1:self_or_descendant_ref"} and all(r["id"] == r["old_id"] for r in bad)


def test_judge(spark):
    nodes = spark.createDataFrame(NODES, "doc_id long, id long, parent long, kind string, page int")
    ops = [(0, "reparent", 5, 3), (1, "move_before", 4, 5), (2, "move_after", 3, 4), (3, "move_before", 7, 4), (4, "merge_flow", 4, 8), (5, "move_before", 99, 4), (6, "merge_flow", 4, 3), (7, "flag_break", 4, None)]
    got = patch.judge(nodes, spark.createDataFrame([(1, *o) for o in ops], "doc_id long, op_ix long, op string, node long, ref long")).orderBy("op_ix").collect()
    assert [r["verdict"] for r in got] == ["ACCEPT", "ACCEPT", "REJECT_ORPHAN", "REJECT_TYPE", "REJECT_PAGE_CROSS", "REJECT_UNKNOWN_ID", "REJECT_TYPE", "ACCEPT"]


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.sql("SELECT '0' AS id, 5L AS pages, TIMESTAMP'2024-05-01' AS created_at, 1 AS unknown UNION ALL SELECT '1', 6L, TIMESTAMP'2024-06-01', 1")
    catalog.insert(rows, path)
    ix = catalog.read(spark, path)
    assert [r["id"] for r in catalog.page(ix, 0, -3).collect()] == ["1"] and ix.count() == 2
    new = catalog.amended(ix, spark.createDataFrame([("0", "done", 99)], "id string, status string, pages long")).orderBy("id").collect()
    assert (new[0]["status"], new[0]["pages"], new[1]["status"]) == ("done", 5, None)
    key = rows.select(catalog.store_key("md/", F.col("created_at"), F.col("id"))).collect()
    assert sorted(r[0] for r in key) == ["md/2024/05/0.md", "md/2024/06/1.md"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "a\nb"), (2, "a\nb"), (3, "c")], ingest.SCHEMA)
    df.coalesce(1).write.parquet(src)
    for _ in range(2):
        ingest.convert(ingest.source(spark, src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 2 and len({r["sha256_input"] for r in got}) == 2


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_order_does_not_depend_on_input(spark, parts):
    from inkfold.plans import registry

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(parts)
    from inkfold.operators import emit

    one = {r["doc_id"]: r["sha256_markdown"] for r in emit.wrapped_markdown(df).collect()}
    two = {r["doc_id"]: r["sha256_markdown"] for r in registry.QUERIES["convert_text"](spark, "/root/testdata/sf0.001").collect()}
    assert one == two


def test_references_without_semicolon(spark):
    got = html.html_blocks(spark.createDataFrame([(1, "<h1>a &amp;&amp</h1><p>b &am</p>")], "page_id long, html string")).orderBy("seq").collect()
    assert [r["text"] for r in got] == ["a &&", "b &am"]
