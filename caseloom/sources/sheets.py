"""Workbooks (OOXML) as data sources: read sheet by sheet, written in bounded parts with styles, choice lists and filterable tables.

spark.read.format("workbook_sheets").load(path) gives (path, sheet, row, cells by column letter) of a workbook or of all *.xlsx in a folder; every sheet is a task of its own; the option `sheets`
(JSON list of names) decides which are opened. A formula's cell is null. df.write.format("workbook").mode("append").save(folder) writes each task's rows as workbooks of at most `rows_per_part` rows (1,000,000; a sheet
holds 1,048,575 below its header), streaming, and renames them once all tasks are done: part-00000.xlsx and on, beside what is there already. Options: `sheet` (its name, Rows), `choices` (JSON: column -> allowed
values, shown as a list). Numbers, booleans, dates and times are cells of their kind, nested values JSON, nulls empty cells, texts never formulas; NaN and infinities are texts. Characters
that XML cannot hold or keep (controls, carriage returns) are written _xHHHH_ and read back. A text of more than 32,767 UTF-16
units fits no cell and fails the write: exports.overlong_cells takes such texts apart first. An empty DataFrame gives one workbook with headers only.
"""

from __future__ import annotations

import json
import math
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from caseloom.sources import workbook
from caseloom.sources.shards import store

CELL = 32767
_MAIN, _REL = workbook._M[1:-1], workbook._R[1:-1]
_PACKAGE, _HEAD = "http://schemas.openxmlformats.org/package/2006", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
# fixed values of the review workbook's look
HEADER_FILL, HEADER_FONT, TEXT_FONT, REVIEWER_FILL = "FF243B53", "FFFFFFFF", "FF243246", "FFFFF4CE"
WIDTH, TEXT_WIDTH, TEXT_COLUMNS = 24, 54, ("text", "title", "body", "quote", "rationale", "notes", "context")
_LOST = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_MARK = re.compile(r"_x([0-9A-Fa-f]{4})_")
_PLAIN, _HEADER, _DATE, _REVIEWER = range(4)


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str
    part: str


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook_sheets"

    def schema(self) -> str:
        return "path string, sheet string, row int, cells map<string,string>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SheetReader(self.options["path"], json.loads(self.options.get("sheets", "null")))


class SheetReader(DataSourceReader):
    def __init__(self, root: str, sheets: list[str] | None):
        self.root, self.sheets = root, sheets

    def partitions(self) -> list[InputPartition]:
        fs, base = store(self.root)
        one = fs.get_file_info(base)
        files = [one] if one.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(base)) if i.extension == "xlsx"]
        out = []
        for path in sorted(i.path for i in files):
            with _opened(fs, path) as z:  # directory and sheet names only
                out += [Sheet(path, name, part) for name, part in workbook.sheet_parts(z) if self.sheets is None or name in self.sheets]
        return out or [Sheet("", "", "")]

    def read(self, p: Sheet) -> Iterator[tuple]:
        if p.path:
            with _opened(store(self.root)[0], p.path) as z:
                for row, cells in workbook.part_rows(z, p.part, workbook.shared_texts(z)):
                    yield p.path, p.sheet, row, {c: v if v is None else unescaped(v) for c, v in cells.items()}


def escaped(text: str) -> str:
    """Text as a cell holds it: what XML would lose as _xHHHH_, and so every underscore that would begin such a mark."""
    return _LOST.sub(lambda m: f"_x{ord(m[0]):04X}_", text)


def unescaped(text: str) -> str:
    return _MARK.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


@contextmanager
def _opened(fs: pafs.FileSystem, path: str) -> Iterator[zipfile.ZipFile]:
    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        yield z


class WorkbookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("workbooks are added to a folder, never put in place of others: use mode('append') and a new folder")
        o = self.options
        return WorkbookWriter(o["path"], schema, o.get("sheet", "Rows"), int(o.get("rows_per_part", 1_000_000)), json.loads(o.get("choices", "{}")))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, root: str, schema: T.StructType, sheet: str, rows: int, choices: dict[str, list[str]]):
        if not 0 < rows < 1 << 20:
            raise ValueError("rows_per_part: 1 to 1,048,575")
        if len({n.lower() for n in schema.names}) < len(schema.names):
            raise ValueError("a sheet's table needs columns of different names")
        self.root, self.schema, self.sheet, self.rows, self.choices, self.job = root, schema, sheet, rows, choices, uuid.uuid4().hex

    def _pending(self) -> tuple[pafs.FileSystem, str, str]:
        fs, base = store(self.root)
        at = posixpath.join(base, f"_pending-{self.job}")
        fs.create_dir(at)
        return fs, base, at

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _, at = self._pending()
        rows, files = (r for b in iterator for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), []
        first = next(rows, None)
        while first is not None:
            files.append(f"{uuid.uuid4().hex}.xlsx")
            with fs.open_output_stream(f"{at}/{files[-1]}") as f:
                first = self._part(f, first, rows)
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        fs, base, at = self._pending()
        files = [f for m in messages if m for f in m.files]
        if not files:
            files = ["none.xlsx"]
            with fs.open_output_stream(f"{at}/none.xlsx") as f:
                self._part(f, None, iter(()))
        there = len([i for i in fs.get_file_info(pafs.FileSelector(base)) if i.extension == "xlsx"])
        for i, f in enumerate(files, there):
            fs.move(f"{at}/{f}", posixpath.join(base, f"part-{i:05d}.xlsx"))
        fs.delete_dir(at)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        fs, _, at = self._pending()
        fs.delete_dir(at)

    def _part(self, f, first: tuple | None, rest: Iterator[tuple]) -> tuple | None:
        """One workbook from `first` and what follows; returns the row that no longer fits, if any."""
        names, n, over = self.schema.names, 0, None
        last = workbook._letters(len(names) - 1)
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                out.write(self._top(names).encode())
                row = first
                while row is not None:
                    if n == self.rows:
                        over = row
                        break
                    n += 1
                    out.write((f'<row r="{n + 1}">' + "".join(_cell(f"{workbook._letters(c)}{n + 1}", v, names[c]) for c, v in enumerate(row)) + "</row>").encode())
                    row = next(rest, None)
                out.write(("</sheetData>" + self._lists(names, n) + ('<tableParts count="1"><tablePart r:id="rId1"/></tableParts>' if n else "") + "</worksheet>").encode())
            if n:
                area = f"A1:{last}{n + 1}"
                columns = "".join(f'<tableColumn id="{i}" name={quoteattr(c)}/>' for i, c in enumerate(names, 1))
                z.writestr("xl/tables/table1.xml", f'{_HEAD}<table xmlns="{_MAIN}" id="1" name="RowsTable" displayName="RowsTable" ref="{area}"><autoFilter ref="{area}"/><tableColumns count="{len(names)}">{columns}</tableColumns></table>')
                z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/table" Target="../tables/table1.xml"/></Relationships>')
            _frame(z, self.sheet, n > 0)
        return over

    def _top(self, names: list[str]) -> str:
        split = 'xSplit="1" ySplit="1" topLeftCell="B2"' if len(names) > 5 else 'ySplit="1" topLeftCell="A2"'
        wide = "".join(f'<col min="{i}" max="{i}" width="{TEXT_WIDTH if any(w in c.lower() for w in TEXT_COLUMNS) else WIDTH}" customWidth="1"/>' for i, c in enumerate(names, 1))
        head = "".join(f'<c r="{workbook._letters(i)}1" s="{_HEADER}" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for i, c in enumerate(names))
        return f'{_HEAD}<worksheet xmlns="{_MAIN}" xmlns:r="{_REL}"><sheetViews><sheetView showGridLines="0" workbookViewId="0"><pane {split} state="frozen"/></sheetView></sheetViews><cols>{wide}</cols><sheetData><row r="1" ht="60" customHeight="1">{head}</row>'

    def _lists(self, names: list[str], n: int) -> str:
        rules = [f'<dataValidation type="list" allowBlank="1" sqref="{workbook._letters(i)}2:{workbook._letters(i)}{max(2, n + 1)}"><formula1>{escape(chr(34) + ",".join(self.choices[c]) + chr(34))}</formula1></dataValidation>' for i, c in enumerate(names) if c in self.choices]
        return f'<dataValidations count="{len(rules)}">{"".join(rules)}</dataValidations>' if rules else ""


def _cell(at: str, v, name: str) -> str:
    style = _REVIEWER if name.startswith("Reviewer") else _PLAIN
    if v is None:
        return f'<c r="{at}" s="{style}"/>' if style else ""
    if isinstance(v, bool):
        return f'<c r="{at}" s="{style}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, datetime | date):
        day = datetime(v.year, v.month, v.day)
        seconds = (v.replace(tzinfo=None) - day).total_seconds() if isinstance(v, datetime) else 0
        return f'<c r="{at}" s="{_DATE}"><v>{(day - datetime(1899, 12, 30)).days + seconds / 86400!r}</v></c>'
    if isinstance(v, int) and abs(v) < 10**15 or isinstance(v, float) and math.isfinite(v):
        return f'<c r="{at}" s="{style}"><v>{v!r}</v></c>'
    text = escaped(json.dumps(v, ensure_ascii=False, sort_keys=True, default=str) if isinstance(v, list | dict | tuple) else str(v))
    if len(text) * 2 > CELL and len(text.encode("utf-16-le", "surrogatepass")) // 2 > CELL:
        raise ValueError(f"{name}, {at}: a text of over {CELL} units fits no cell; split it with exports.overlong_cells")
    return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _frame(z: zipfile.ZipFile, sheet: str, table: bool) -> None:
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    tables = f'<Override PartName="/xl/tables/table1.xml" ContentType="{kind}.table+xml"/>' if table else ""
    z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/>{tables}</Types>')
    z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name={quoteattr(sheet[:31])} sheetId="1" r:id="rId1"/></sheets></workbook>')
    z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
    font = lambda color, bold="": f'<font>{bold}<sz val="10"/><color rgb="{color}"/><name val="Arial"/></font>'
    fill = lambda color: f'<fill><patternFill patternType="solid"><fgColor rgb="{color}"/></patternFill></fill>'
    looks = '<xf fontId="0" fillId="0" numFmtId="0" borderId="0" xfId="0" applyAlignment="1"><alignment vertical="top"/></xf>'
    looks += '<xf fontId="1" fillId="2" numFmtId="0" borderId="0" xfId="0" applyFont="1" applyFill="1" applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf>'
    looks += '<xf fontId="0" fillId="0" numFmtId="164" borderId="0" xfId="0" applyNumberFormat="1"/><xf fontId="0" fillId="3" numFmtId="0" borderId="0" xfId="0" applyFill="1"/>'
    z.writestr(
        "xl/styles.xml",
        f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="mm/dd/yyyy hh:mm"/></numFmts><fonts count="2">{font(TEXT_FONT)}{font(HEADER_FONT, "<b/>")}</fonts>'
        f'<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill(HEADER_FILL)}{fill(REVIEWER_FILL)}</fills><borders count="1"><border/></borders>'
        f'<cellStyleXfs count="1"><xf fontId="0" fillId="0" numFmtId="0" borderId="0"/></cellStyleXfs><cellXfs count="4">{looks}</cellXfs></styleSheet>',
    )


def register(spark: SparkSession) -> None:
    """Makes the formats workbook_sheets and workbook known to the session."""
    for source in (SheetSource, WorkbookSink):
        spark.dataSource.register(source)
