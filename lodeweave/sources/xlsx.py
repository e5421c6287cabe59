"""Workbooks as a data source and a sink, on the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Characters that the format's XML can't hold.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def read_workbook(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells as text) of every row, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = rels[sheet.get(f"{_REL}id")].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                n = 0
                for _, row in ET.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    n = int(row.get("r") or n + 1)
                    cells: list[str | None] = []
                    for k, c in enumerate(row.iter(f"{_MAIN}c")):
                        i = _column(c.get("r")) if c.get("r") else k
                        cells += [None] * (i + 1 - len(cells))
                        v = c.find(f"{_MAIN}v")
                        if c.get("t") == "inlineStr":
                            cells[i] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                        elif v is not None and v.text is not None:
                            cells[i] = shared[int(v.text)] if c.get("t") == "s" else v.text
                    yield sheet.get("name"), n, cells
                    row.clear()


def write_workbook(path: str, sheets: list[tuple[str, list[str], Iterator]]) -> None:
    """A workbook of (name, header, rows), streamed row by row; no sheet gives an empty one."""
    sheets = sheets or [("Sheet1", [], iter(()))]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets))) + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, (n, _, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, (_, header, rows) in enumerate(sheets):
            with z.open(f"xl/worksheets/sheet{i + 1}.xml", "w") as f:
                f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                n = 0
                for row in ([header] if header else []) + [None]:
                    for values in [row] if row is not None else rows:
                        n += 1
                        cells = []
                        for k, v in enumerate(values):
                            if v is None:
                                continue
                            ref = f"{_name(k)}{n}"
                            if isinstance(v, bool) or not isinstance(v, (int, float)):
                                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", str(v)))}</t></is></c>')
                            else:
                                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
                        f.write(f'<row r="{n}">{"".join(cells)}</row>'.encode())
                f.write(b"</sheetData></worksheet>")


class XlsxDataSource(DataSource):
    """``spark.read.format("xlsx")``: all sheets, or those not in ``skip`` (names joined by |), as
    rows of text; columns are found by their header's name without spaces around it, missing
    ones are null. One partition per file; ``path`` is a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "sheet string, row_no int, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XlsxReader(self.options, schema)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _XlsxReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.skip = {s for s in options.get("skip", "").split("|") if s}

    def partitions(self):
        import os

        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith(".xlsx")]
        return [_File(self.path)]

    def read(self, partition):
        names = [f.name for f in self.schema.fields]
        raw = names == ["sheet", "row_no", "cells"]
        header: dict[str, dict[str, int]] = {}
        with open(partition.path, "rb") as f:
            data = f.read()
        for sheet, n, cells in read_workbook(data):
            if sheet in self.skip:
                continue
            if raw:
                yield sheet, n, cells
            elif sheet not in header:
                header[sheet] = {(c or "").strip(): i for i, c in reversed(list(enumerate(cells)))}
            else:
                at = header[sheet]
                yield tuple({"sheet": sheet, "row_no": n}.get(x, cells[at[x]] if x in at and at[x] < len(cells) else None) if x in ("sheet", "row_no") else (cells[at[x]] if x in at and at[x] < len(cells) else None) for x in names)


def register(spark) -> None:
    spark.dataSource.register(XlsxDataSource)
