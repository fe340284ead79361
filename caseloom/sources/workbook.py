"""Spreadsheet workbooks (OOXML): a distributed reader and a writer of bounded parts, standard library only."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_NOT_XML = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, dict[str, str | None]]]:
    """(sheet, row, cells by column letter). A formula's cell is None: its value was not typed in."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        texts = shared_texts(z)
        for name, part in sheet_parts(z):
            for row, cells in part_rows(z, part, texts):
                yield name, row, cells


def shared_texts(z: zipfile.ZipFile) -> list[str]:
    """The workbook's table of texts that cells refer to."""
    return [_text(e) for e in _streamed(z, "xl/sharedStrings.xml", "si")]


def sheet_parts(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet, its part in the archive), in the workbook's order."""
    parts = {e.attrib["Id"]: posixpath.normpath(posixpath.join("/xl", e.attrib["Target"]))[1:] for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return [(e.attrib["name"], parts[e.attrib[f"{_R}id"]]) for e in _streamed(z, "xl/workbook.xml", "sheet")]


def part_rows(z: zipfile.ZipFile, part: str, texts: list[str]) -> Iterator[tuple[int, dict[str, str | None]]]:
    """(row, cells by column letter) of one sheet, streaming."""
    for row in _streamed(z, part, "row"):
        cells = ((re.sub("[0-9]+", "", e.attrib["r"]), e) for e in row.findall(f"{_M}c"))
        yield int(row.attrib["r"]), {column: _cell(e, texts) for column, e in cells}


def _streamed(z: zipfile.ZipFile, part: str, tag: str) -> Iterator[ET.Element]:
    """The elements of a part as they end, each freed after use; none where the archive has no such part."""
    if part in z.NameToInfo:
        with z.open(part) as f:
            for _, e in ET.iterparse(f):
                if e.tag == _M + tag:
                    yield e
                    e.clear()


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))


def _cell(c: ET.Element, texts: list[str]) -> str | None:
    if c.find(f"{_M}f") is not None:
        return None
    if c.get("t") == "inlineStr":
        return _text(c)
    v = c.findtext(f"{_M}v")
    return texts[int(v)] if c.get("t") == "s" and v is not None else v


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.map_(pa.string(), pa.string())
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = list(sheet_rows(content))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([list(r[2].items()) for r in rows], kind)], names=["path", "sheet", "row", "cells"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of all workbooks under path; each workbook is read by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(_read, "path string, sheet string, row int, cells map<string,string>")


def phrases(cells: DataFrame, header: str = "Search Phrase") -> DataFrame:
    """(path, sheet, row, phrase) below the header cell of every sheet that has one: in its first row that holds it, leftmost."""
    from pyspark.sql import functions as F

    heads = cells.select("path", "sheet", "row", F.explode("cells").alias("col", "v")).where(F.trim("v") == header)
    at = heads.groupBy("path", "sheet").agg(F.min(F.struct("row", F.length("col").alias("wide"), "col")).alias("at"))
    found = cells.join(F.broadcast(at), ["path", "sheet"]).where("row > at.row").select("path", "sheet", "row", F.element_at("cells", F.col("at.col")).alias("phrase"))
    return found.where(F.trim("phrase") != "")


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def workbook_bytes(tables: dict[str, tuple[list[str], list]]) -> bytes:
    """A workbook of inline strings and numbers, headers frozen. One part of bounded rows at a time (see exports.workbook_parts)."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rel = _M[1:-1], _R[1:-1]
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(tables)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
        for i, (headers, rows) in enumerate(tables.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                for r, row in enumerate([headers, *rows], 1):
                    f.write((f'<row r="{r}">' + "".join(_xml(f"{_letters(c)}{r}", v) for c, v in enumerate(row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _xml(at: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, int | float) and not isinstance(v, bool):
        return f'<c r="{at}"><v>{v}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", str(v)))}</t></is></c>'
