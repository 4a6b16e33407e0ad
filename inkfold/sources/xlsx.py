"""Spreadsheets (OOXML) as headings and tables: the package's XML is read in a worker, the grid rules are DataFrame operations."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS, MOST_COLS = 500, 64
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATES = frozenset([*range(14, 23), *range(45, 48)])  # built-in date formats


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref.replace("$", "")).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def _number(raw: str, dated: bool) -> str:
    v = float(raw)
    if not dated:
        return str(int(v)) if v.is_integer() else repr(v)
    at = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=v)
    at = (at + datetime.timedelta(microseconds=500)).replace(microsecond=0)
    if v < 1:
        return at.time().isoformat()
    return at.date().isoformat() if at.time() == datetime.time.min else at.isoformat()


def _sheets(raw: bytes) -> Iterator[tuple[int, str, list[tuple[int, int, str]], list[tuple[int, int, int, int]]]]:
    """(number, title, cells, merges) of each sheet."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        rel = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = [("".join(t.text or "" for t in s.iter(f"{_NS}t"))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            style = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode") or ""), re.I)) for f in style.iter(f"{_NS}numFmt")}
            xfs = style.find(f"{_NS}cellXfs")
            dated = [own.get(k := int(x.get("numFmtId") or 0), k in _DATES) for x in (xfs if xfs is not None else [])]
        for number, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"), 1):
            target = rel.get(sheet.get(_REL)) or ""
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            cells, merges = [], []
            if part in names:
                with z.open(part) as f:
                    for _, x in ElementTree.iterparse(f):
                        if x.tag == f"{_NS}c" and x.get("r"):
                            kind, v = x.get("t"), x.findtext(f"{_NS}v")
                            if kind == "inlineStr":
                                text = "".join(t.text or "" for t in x.iter(f"{_NS}t"))
                            elif v is None:
                                text = ""
                            elif kind == "s":
                                text = shared[int(v)]
                            elif kind == "b":
                                text = "TRUE" if v == "1" else "FALSE"
                            elif kind in ("str", "e", "d"):
                                text = v
                            else:
                                s = int(x.get("s") or 0)
                                text = _number(v, s < len(dated) and dated[s])
                            if text:
                                cells.append((*_place(x.get("r")), text))
                        elif x.tag == f"{_NS}mergeCell" and ":" in (x.get("ref") or ""):
                            try:
                                merges.append(tuple(n for r in x.get("ref").split(":") for n in _place(r)))
                            except AttributeError:
                                continue  # the merge is lost, the data is not
                        if x.tag in (f"{_NS}row", f"{_NS}mergeCell"):
                            x.clear()
            yield number, sheet.get("name") or "", cells, merges


def sheets(files: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(id, page, title, status, cells, merges) of each sheet; a file that is no workbook has one row with its status."""
    cell = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())]))
    merge = pa.list_(pa.struct([(n, pa.int32()) for n in ("r0", "c0", "r1", "c1")]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = [(key, n, t, "ok", [dict(zip(("row", "col", "text"), c)) for c in cs], [dict(zip(("r0", "c0", "r1", "c1"), m)) for m in ms]) for n, t, cs, ms in _sheets(raw or b"")]
                except Exception as e:  # noqa: BLE001 - named by type alone, never by content
                    rows = [(key, None, None, type(e).__name__, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.string(), cell, merge))], ["id", "page", "title", "status", "cells", "merges"])

    schema = "id long, page int, title string, status string, cells array<struct<row:int,col:int,text:string>>, merges array<struct<r0:int,c0:int,r1:int,c1:int>>"
    return files.select(F.col(id_col).cast("long").alias("id"), F.col(content).cast("binary").alias("content")).mapInArrow(go, schema)


def tables(sheet: DataFrame) -> DataFrame:
    """(id, page, row_count, col_count, truncated, row, col, row_span, col_span, text, is_header): capped, trimmed to what is used
    (merges with a value count as used), covered cells left out. One row for each cell of the dense grid."""
    s = sheet.where("status = 'ok'")
    keep = F.filter("cells", lambda c: (c["row"] < MOST_ROWS) & (c["col"] < MOST_COLS))
    s = s.withColumn("kept", keep).withColumn("truncated", F.size("kept") < F.size("cells"))
    s = s.withColumn("rows_", F.coalesce(F.array_max(F.transform("kept", lambda c: c["row"])), F.lit(-1)))
    valued = F.filter("merges", lambda m: F.exists("kept", lambda c: (c["row"] == m["r0"]) & (c["col"] == m["c0"])))
    s = s.withColumn("v", valued)
    s = s.withColumn("last_row", F.greatest(F.col("rows_"), F.coalesce(F.array_max(F.transform("v", lambda m: F.least(m["r1"], F.lit(MOST_ROWS - 1)))), F.lit(-1))))
    s = s.withColumn("last_col", F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda c: c["col"])), F.lit(-1)), F.coalesce(F.array_max(F.transform("v", lambda m: F.least(m["c1"], F.lit(MOST_COLS - 1)))), F.lit(-1))))
    s = s.where("last_row >= 0")
    m = F.map_from_entries(F.transform("kept", lambda c: F.struct((c["row"] * MOST_COLS + c["col"]).alias("k"), c["text"].alias("t"))))
    s = s.withColumn("m", m)
    g = s.select("id", "page", (F.col("last_row") + 1).alias("row_count"), (F.col("last_col") + 1).alias("col_count"), "truncated", "merges", "m", "last_row", "last_col", F.explode(F.sequence(F.lit(0), F.col("last_row"))).alias("row"))
    g = g.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("last_col"))))
    covers = lambda x: (F.col("row") >= x["r0"]) & (F.col("row") <= x["r1"]) & (F.col("col") >= x["c0"]) & (F.col("col") <= x["c1"])
    top = lambda x: (F.col("row") == x["r0"]) & (F.col("col") == x["c0"])
    g = g.where(~F.exists("merges", lambda x: covers(x) & ~top(x)))
    mine = F.try_element_at(F.filter("merges", top), F.lit(-1))
    span = lambda hi, lo, last: F.coalesce(F.least(mine[hi], F.col(last)) - mine[lo] + 1, F.lit(1))
    return g.select(
        "id", "page", "row_count", "col_count", "truncated", "row", "col", span("r1", "r0", "last_row").alias("row_span"), span("c1", "c0", "last_col").alias("col_span"),
        F.coalesce(F.try_element_at("m", F.col("row") * MOST_COLS + F.col("col")), F.lit("")).alias("text"), (F.col("row") == 0).alias("is_header"),
    )
