"""Page layout, ownership, windows, answers and provider trees on small hand-made inputs and against plain versions."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from inkfold.operators import bands, claims, joins, layout, ranks, review, tree_build, trees
from inkfold.plans import catalogue_more
from inkfold.sources import media, provider

RECT = "x0 long, y0 long, x1 long, y1 long"


def page(spark, blocks, lines=(), marks=(), tables=()):
    """blocks: (ix, text, rect or None, zone); lines: (block, ix, text, rect); all on page 1 of document 1."""
    flat = lambda r: (None,) * 4 if r is None else r
    b = spark.createDataFrame([(1, i, z, t, *flat(r)) for i, t, r, z in blocks], f"page long, block_ix long, zone string, text string, {RECT}")
    li = spark.createDataFrame([(1, b_, i, t, *flat(r)) for b_, i, t, r in lines], f"page long, block_ix long, line_ix int, text string, {RECT}")
    m = spark.createDataFrame([(1, i, s, *flat(r)) for i, s, r in marks], f"page long, mark_ix int, selected boolean, {RECT}")
    t = spark.createDataFrame([(1, i, *flat(r)) for i, r in tables], f"page long, table_ix int, {RECT}")
    atoms = layout.page_atoms(b, li, m, t, ["page"])
    return b, li, atoms


def order_of(spark, *parts):
    b, li, atoms = page(spark, *parts)
    banded = layout.banded_atoms(atoms, ["page"])
    got = layout.reading_order(banded, bands.page_em(banded, ["page"]), b, li, ["page"]).orderBy("pos").collect()
    return [(r["kind"], r["source_ix"]) for r in got], got


def cell(i, x, row, width=10_000):
    return (i, f"t{i}", (x, row * 1_500, x + width, row * 1_500 + 1_000), "body")


def test_atoms(spark):
    r = (0, 0, 9_000, 1_000)
    blocks = [(0, "a b", None, "body"), (1, "hull", (0, 5_000, 9_000, 9_000), "body"), (2, "gone", None, "body"), (3, "in table", r, "table"), (4, "one row", (0, 9_500, 9_000, 10_500), "body")]
    b, li, atoms = page(spark, blocks, [(0, 0, "a", r), (0, 1, "b", (0, 2_000, 9_000, 3_000)), (4, 0, "no rect", None)], [(0, True, (0, 0, 900, 1_000)), (1, False, None)], [(0, (0, 12_000, 9_000, 13_000))])
    got = sorted((r["kind"], r["source_ix"], r["sub_ix"], r["text"], r["multiline"]) for r in atoms.collect())
    assert got == [("line", 0, 0, "a", False), ("line", 0, 1, "b", False), ("line", 1, 0, "hull", True), ("line", 4, 0, "one row", False), ("mark", 0, 0, "[x]", False), ("table", 0, 0, "", False)]
    assert [r["block_ix"] for r in layout.floating(b, li, ["page"]).collect()] == [2]


def test_columns_are_read_down(spark):
    left, right = [cell(i, 0, i) for i in range(5)], [cell(10 + i, 20_000, i) for i in range(5)]
    got, rows = order_of(spark, left + right)
    assert [s for _, s in got] == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14] and {r["frame_ix"] for r in rows} == {0, 1}
    hebrew = [(i, "שלום עולם", r, z) for i, _, r, z in left + right]
    assert [s for _, s in order_of(spark, hebrew)[0]] == [10, 11, 12, 13, 14, 0, 1, 2, 3, 4]
    # three rows are no columns; a full-width line parts two pairs of columns
    assert [s for _, s in order_of(spark, left[:3] + right[:3])[0]] == [0, 10, 1, 11, 2, 12]
    wide = (50, "wide", (0, 9_000, 30_000, 10_000), "body")
    below = [cell(60 + i, 0, 8 + i) for i in range(4)] + [cell(70 + i, 20_000, 8 + i) for i in range(4)]
    assert [s for _, s in order_of(spark, left + right + [wide] + below)[0]] == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 50, 60, 61, 62, 63, 70, 71, 72, 73]


def test_nested_columns(spark):
    """A frame whose lower part has two columns of its own beside a tall neighbour."""
    left = [cell(i, 0, i, 30_000) for i in range(4)] + [cell(20 + i, 0, 6 + i) for i in range(5)] + [cell(40 + i, 20_000, 6 + i) for i in range(5)]
    right = [cell(100 + i, 60_000, i, 30_000) for i in range(11)]
    got, rows = order_of(spark, left + right)
    assert [s for _, s in got] == [0, 1, 2, 3, 20, 21, 22, 23, 24, 40, 41, 42, 43, 44, *range(100, 111)]
    assert {r["depth"] for r in rows} >= {1, 3}


def test_declines(spark):
    pages = spark.createDataFrame([(1, 10, 10), (2, 10, 10), (3, 0, 10)], "page long, width int, height int")
    b, li, atoms = page(spark, [cell(i, 0, i) for i in range(5)] + [cell(10 + i, 20_000, i) for i in range(4)] + [(99, "tall", (20_000, 6_000, 30_000, 9_900), "body")])
    banded = layout.banded_atoms(atoms, ["page"])
    got = {r["page"]: (r["regions"], r["spatial"], r["reason"]) for r in layout.page_layout(pages, banded, bands.page_em(banded, ["page"]), b, li, ["page"]).collect()}
    assert got == {1: (0, 0, "multiline"), 2: (0, 0, "no-geometry"), 3: (0, 0, "no-geometry")}
    b, li, atoms = page(spark, [cell(i, 0, i) for i in range(5)] + [cell(10 + i, 20_000, i) for i in range(5)], [(0, 0, "t", (0, 0, 10_000, 1_000))])
    banded = layout.banded_atoms(atoms, ["page"])  # a block's line does not say its text
    assert layout.page_layout(pages, banded, bands.page_em(banded, ["page"]), b, li, ["page"]).where("page = 1").first()["reason"] == "coverage"


def test_band_windows(spark):
    rng = random.Random(1)

    def cuts(b, cap):
        out, at = [], 0
        while len(b) - at > cap:
            turns = [k for k in range(at + 1, at + cap + 1) if b[k] != b[k - 1]]
            at = turns[-1] if turns else at + cap
            out.append(at)
        return out

    rows, want = [], {}
    for d in range(50):
        b = sorted(rng.randrange(rng.choice([1, 3, 12])) for _ in range(rng.randrange(1, 60)))
        for i, x in enumerate(b):
            rows.append((d, i, x))
            want[d, i] = sum(k <= i for k in cuts(b, 8))
    got = review.band_windows(spark.createDataFrame(rows, "d long, i long, b long"), ["d"], "i", "b", 8).collect()
    assert {(r["d"], r["i"]): r["window"] for r in got} == want


def test_canonical_json(spark):
    got = spark.range(1).select(review.canonical_json({"b": F.lit(1), "a": F.lit("é😀\"x"), "c": F.lit(None).cast("string")})).first()[0]
    assert got == json.dumps({"a": "é😀\"x", "b": 1}, sort_keys=True, separators=(",", ":"))


@pytest.mark.parametrize("seed", range(3))
def test_tree_checks(spark, seed):
    sound = [(1, 0, None, "document"), (1, 1, 0, "body"), (1, 2, 1, "section"), (1, 3, 2, "paragraph"), (1, 4, 1, "paragraph"), (1, 5, 0, "furniture")]
    broken = [[(2, 0, None, "document"), (2, 1, 0, "body"), (2, 2, 1, "section"), (2, 3, 1, "paragraph"), (2, 4, 2, "paragraph"), (2, 5, 0, "furniture")], [(2, 0, None, "document"), (2, 1, 0, "body"), (2, 3, 9, "paragraph"), (2, 4, 0, "furniture")], [(2, 0, None, "body"), (2, 1, 0, "furniture")]][seed]
    want = [{"I1:preorder"}, {"I1:id_index", "I1:preorder", "I2:parent_ref"}, {"I2:document_root", "I2:root_children"}][seed]
    nodes = spark.createDataFrame(sound + broken, "doc long, id long, parent long, kind string")
    flow = spark.createDataFrame([(1, 3, 4)], "doc long, src long, dst long")
    got = {(r["doc"], r["violation"]) for r in review.violations(nodes, flow, ["doc"]).collect()}
    assert got == {(2, v) for v in want}
    bad = spark.createDataFrame([(1, 3, 4), (1, 3, 4), (1, 4, 3), (1, 2, 3)], "doc long, src long, dst long")
    assert (1, "I4:flow") in {(r["doc"], r["violation"]) for r in review.violations(nodes, bad, ["doc"]).collect()}


def test_spans_of_several_pieces(spark):
    """Two paragraphs whose lines alternate: each gets its own."""
    at = lambda *s: [{"offset": o, "length": n} for o, n in s]
    doc = {"paragraphs": [{"content": "A", "spans": at((0, 5), (20, 5))}, {"content": "B", "spans": at((10, 5), (30, 5))}, {"content": "C", "span": {"offset": 40, "length": 3}}, {"content": "D", "spans": at((-3, 9))}], "pages": [{"lines": [{"content": f"l{i}", "spans": at((i * 10, 5))} for i in range(5)] + ["no", {"content": "far", "spans": at((90, 2))}]}]}
    got = provider.attached_lines(provider.parsed(spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, None)], "doc_id long, json string"))).collect()
    assert sorted((r["text"], r["block_ix"]) for r in got) == [("l0", 0), ("l1", 1), ("l2", 0), ("l3", 1), ("l4", 2)]


def test_harvest(spark):
    deep = {"sections": [{"elements": ["/sections/1", "/paragraphs/0", "/paragraphs/9", "/sections/7", 5, "/sections/2"]}, {"elements": ["/paragraphs/1", "/sections/2", "/tables/0", "paragraphs/1"]}, {"elements": ["/paragraphs/0", "/sections/1", "/paragraphs/0", "/figures/0"]}], "paragraphs": [{"content": c} for c in "ab"], "tables": [{}], "figures": [{"caption": {"elements": ["/paragraphs/5", "/paragraphs/1"]}}]}
    p = provider.parsed(spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps({"paragraphs": [{"content": "x"}]}))], "doc_id long, json string"))
    got = provider.harvest(p).orderBy("seq").collect()
    assert [(r["kind"], r["ix"], r["section_ix"], r["depth"]) for r in got] == [("section", 0, None, 0), ("section", 1, 0, 1), ("paragraph", 1, 1, 2), ("section", 2, 1, 2), ("paragraph", 0, 2, 3), ("figure", 0, 2, 3), ("table", 0, 1, 2)]
    assert tuple(got[0])[-3:] == (4, 2, 2) and {r["doc_id"] for r in got} == {1}
    assert [r["paragraph_ix"] for r in provider.captions(p).collect()] == [1]
    tree = tree_build.provider_tree(p).orderBy("doc_id", "id").collect()
    assert [r["path"] for r in tree if r["doc_id"] == 1] == ["//doc", "//doc/body[1]", "//doc/body[1]/sect[1]", "//doc/body[1]/sect[1]/sect[1]", "//doc/body[1]/sect[1]/sect[1]/p[1]", "//doc/body[1]/sect[1]/sect[1]/fig[1]", "//doc/body[1]/sect[1]/sect[1]/fig[1]/cap[1]", "//doc/body[1]/sect[1]/tbl[1]", "//doc/furn[1]"]
    assert [r["path"] for r in tree if r["doc_id"] == 2] == ["//doc", "//doc/body[1]", "//doc/body[1]/p[1]", "//doc/furn[1]"]
    nodes = tree_build.provider_tree(p).withColumn("kind", F.when(F.col("kind") == "caption", "paragraph").otherwise(F.col("kind")))
    assert review.violations(nodes, spark.createDataFrame([], "doc_id long, src long, dst long"), ["doc_id"]).count() == 0


def test_bytes_of_other_encodings(spark):
    rows = [("<html><p>é".encode("latin-1"), None), ("﻿hello".encode("utf-16-le"), None), ("﻿From: a\nTo: b\n\nx".encode("utf-16-be"), None), (b"\xff\xfe\x00\xd8", None), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a.msg"), (b"RIFF1234WEBP", None), (b"1234ftypheic", None), (b"BM" + bytes(12) + (41).to_bytes(4, "little") + bytes(20), None)]
    df = media.ooxml_kinds(spark.createDataFrame(rows, "content binary, name string"))
    got = [r[0] for r in df.select(media.classify(F.col("content"), F.col("name"), F.col("package"), F.col("wide_text"))["kind"]).collect()]
    assert got == ["html", "text", "email", "other", "other", "other", "image", "other"]
    routes = spark.range(1).select(media.route(F.lit("html"), F.lit(False), F.lit("plain"), F.lit(1 << 26)).alias("r")).first()["r"]
    assert tuple(routes) == ("too_large", 413)


@pytest.mark.parametrize("n", [1, 7, 400])
def test_ranks_and_inversions(spark, n):
    rng = random.Random(n)
    rows = [(k % 3, i, rng.randrange(50)) for k, i in enumerate(rng.sample(range(10_000), n))]
    df = spark.createDataFrame(rows, "key long, a long, b long")
    got = {r["a"]: r["rank"] for r in ranks.ranked(df, ["a"]).collect()}
    assert got == {a: i for i, a in enumerate(sorted(r[1] for r in rows))}
    for r in trees.kendall(df, ["key"], "a", "b").collect():
        own = [(x[1], x[2]) for x in rows if x[0] == r["key"]]
        bad = sum(p[0] < q[0] and p[1] > q[1] for p in own for q in own)
        assert (r["pairs"], r["discordant"]) == (len(own) * (len(own) - 1) // 2, bad)


def test_lines_without_a_block(spark):
    """Lines of a block that is missing are not attached to another."""
    lines = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 6, 5), (1, 2, 12, 0)], "doc_id long, line_ix int, off long, len long")
    blocks = spark.createDataFrame([(1, 0, 0, 5), (1, 2, 12, 4)], "doc_id long, block_ix int, off long, len long")
    assert {(r["line_ix"], r["block_ix"]) for r in joins.span_join(lines, blocks).collect()} == {(0, 0), (2, 2)}


def test_sections_missing_on_a_page(spark):
    """Sections conflict only on pages where both are, and share a column."""
    rows = [(1, 1, s, b, 0, 100) for s, b in ((1, 0), (1, 9), (2, 3))] + [(1, 2, 1, 0, 0, 100), (1, 3, 2, 0, 0, 100), (1, 4, 1, 5, 0, 100), (1, 4, 2, 4, 0, 100), (1, 5, 1, 5, 0, 100), (1, 5, 2, 4, 200, 300)]
    got = trees.conflicts(spark.createDataFrame(rows, "doc long, page long, section long, band long, col_x0 long, col_x1 long"), ["doc"]).collect()
    assert sorted(r["page"] for r in got) == [1, 4]


def test_claims(spark):
    b = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a")], "d long, block_ix int, text string")
    n = spark.createDataFrame([(1, 3, "a"), (1, 4, " "), (1, 8, "b"), (2, 0, "a"), (2, 1, "c")], "d long, node_ix int, text string")
    assert sorted((r["d"], r["block_ix"], r["node_ix"]) for r in claims.zip_positions(b, n, ["d"]).collect()) == [(1, 0, 3), (1, 1, 8)]
    kv = spark.createDataFrame([(1, "Key", "v  1"), (1, "Key", "zz"), (2, "a", "b")], "page long, key string, value string")
    at = spark.createDataFrame([(1, "the KEY is"), (1, "v 1 x")], "page long, text string")
    assert sorted((r["page"], r["value"], r["on_canvas"]) for r in claims.said_on_canvas(kv, at, ["page"]).collect()) == [(1, "v  1", True), (1, "zz", False), (2, "b", False)]


def test_canvas_breaks(spark):
    """An atom that drifts too far, or leaves its frame, goes on in a row of its own; right-to-left texts snap by their ends."""
    from inkfold.operators import canvas

    atoms = [(1, 0, "line", "abcdefgh", 0, 0, 8_000, 1_000), (1, 1, "line", "x", 1_000, 100, 2_000, 1_100), (1, 2, "line", "right", 20_000, 0, 25_000, 1_000), (1, 3, "line", "next", 0, 4_000, 4_000, 5_000)]
    schema = f"page long, atom_ix long, kind string, text string, {RECT}"
    banded = bands.bands(spark.createDataFrame(atoms, schema), ["page"])
    fr = spark.createDataFrame([(1, 0, 0, 10_000, 1_000, 10, 0), (1, 1, 20_000, 25_000, 1_000, 5, 13)], "page long, frame_ix int, frame_x0 long, frame_x1 long, adv long, cells long, col_start long")
    em = spark.createDataFrame([(1, 1_000)], "page long, em long")
    got = canvas.rows(bands.tab_stops(banded, fr, ["page"]), banded, fr, em, ["page"]).orderBy("row").collect()
    assert [(r["row"], r["text"]) for r in got] == [(0, "abcdefgh"), (1, "x" + " " * 12 + "right"), (4, "next")]
    hebrew = [(1, i, "line", t, x1 - 1_000 * len(t), i * 2_000, x1, i * 2_000 + 1_000) for i, (t, x1) in enumerate([("שלום", 9_000), ("שלום עולם", 9_000), ("של", 8_000), ("abc", 4_000)])]
    b = bands.bands(spark.createDataFrame(hebrew, schema), ["page"])
    stops = {r["atom_ix"]: (r["col"], r["stop"]) for r in bands.tab_stops(b, fr.where("frame_ix = 0"), ["page"]).collect()}
    assert stops == {0: (5, 5), 1: (0, 0), 2: (6, 7), 3: (1, 1)}


def test_captions_within_a_layout(spark):
    """The first paragraph by number whose spans meet the caption's, unless the caption names one that there is."""
    spans = lambda *s: {"spans": [{"offset": a, "length": n} for a, n in s]}
    figure = lambda refs, *s: {"caption": {"elements": refs, **spans(*s)}}
    paragraphs = [3, {"content": "a"}, {"content": "b", **spans((50, 5), (0, 5))}, {"content": "c", "span": {"offset": 2, "length": 9}}, {"content": "d", **spans((-4, 90))}]
    figures = [figure([], (8, 1), (3, 1)), figure([], (10, 1)), figure(["/paragraphs/4", "/tables/0", "/paragraphs/3"], (0, 1)), figure(["/paragraphs/4"]), "none", {"caption": 1}, figure([], (70, 5))]
    rows = [(1, json.dumps({"paragraphs": paragraphs, "figures": figures})), (2, json.dumps({"figures": [figure(["/paragraphs/0"], (0, 9))]})), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, json string")
    want = [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, None), (1, 4, None), (1, 5, None), (2, 0, None)]
    for lists in (provider.LISTS, provider.CAPTIONS):
        got = provider.captions(provider.parsed(df, lists=lists)).orderBy("doc_id", "figure_ix").collect()
        assert [(r["doc_id"], r["figure_ix"], r["paragraph_ix"]) for r in got] == want


def test_lines_of_long_paragraphs(spark, tmp_path):
    """Pieces of 78 characters with their offsets, in time that grows with the text and not with its square."""
    texts = ["ab\n" + "😀\r" * 100 + "\n\nx", "é" * 2_000_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    got = {r["doc_id"]: json.loads(r["json"]) for r in catalogue_more._layout_json(spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 30
    for k, text in enumerate(texts):
        want, at = [], 0
        for line in text.split("\n"):
            want += [(line[i : i + 78], at + i, len(line[i : i + 78])) for i in range(0, len(line), 78)]
            at += len(line) + 1
        assert [(x["content"], x["spans"][0]["offset"], x["spans"][0]["length"]) for x in got[k]["pages"][0]["lines"]] == want


def test_marks_of_pages_and_layouts(spark):
    pages = [{"selectionMarks": [{"state": "selected"}, 7, {}], "lines": [1]}, "no", {"pageNumber": 5, "selectionMarks": [{"state": 3}]}]
    rows = [(1, json.dumps({"pages": pages, "selectionMarks": [None, {"boundingRegions": [4, {"pageNumber": 8}]}]})), (2, json.dumps({"readResults": [{"page": 1}]})), (3, "{")]
    df = spark.createDataFrame(rows, "doc_id long, json string")
    want = [(1, 0, 1, "selected"), (1, 1, 1, "unselected"), (1, 2, 5, "3"), (1, 3, 8, "unselected")]
    for lists in (provider.LISTS, provider.MARKS):
        p = provider.parsed(df, lists=lists)
        assert [tuple(r)[:4] for r in provider.marks(p).orderBy("doc_id", "mark_ix").collect()] == want
        assert [r["shape"] for r in p.orderBy("doc_id").collect()] == ["layout", "read", "layout"]


def test_trees_without_blocks(spark):
    """Figures and tables of a layout that says nothing hang in a whole tree, as in any other; an empty layout has its three nodes."""
    bare = {"sections": [{"elements": ["/sections/1"]}, {"elements": ["/figures/0", "/paragraphs/0"]}], "paragraphs": [{"content": " "}], "figures": [{}], "tables": [{}]}
    p = provider.parsed(spark.createDataFrame([(1, json.dumps(bare)), (2, "{}"), (3, None)], "doc_id long, json string"))
    tree = tree_build.provider_tree(p).orderBy("doc_id", "id").collect()
    paths = {d: [r["path"] for r in tree if r["doc_id"] == d] for d in (1, 2, 3)}
    assert paths[1] == ["//doc", "//doc/body[1]", "//doc/body[1]/sect[1]", "//doc/body[1]/sect[1]/fig[1]", "//doc/body[1]/tbl[1]", "//doc/furn[1]"]
    assert paths[2] == paths[3] == ["//doc", "//doc/body[1]", "//doc/furn[1]"]
    assert [r["parent"] for r in tree if r["doc_id"] == 1] == [None, 0, 1, 2, 1, 0]
    assert review.violations(tree_build.provider_tree(p), spark.createDataFrame([], "doc_id long, src long, dst long"), ["doc_id"]).count() == 0
