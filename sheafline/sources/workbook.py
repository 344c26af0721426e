"""Workbooks: xlsx and ods sheets as grids, and grids as xlsx workbooks; also as the data source `workbook`."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sheafline.operators.structured import scalar, scalar_text, width
from sheafline.plans.rows import CodedError, explode_rows, map_rows

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
TABLE, TEXT, OFFICE = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % n for n in ("table", "text", "office"))
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
SHEET_NAME = 31
ROW = "sheet string, sheet_pos int, row_pos int, cells array<string>"
#: Most empty columns or rows that a repeat count may add.
MOST_REPEAT = 1024


def date_text(day: datetime.datetime) -> str:
    day = (day + datetime.timedelta(microseconds=500_000)).replace(microsecond=0)
    return day.strftime("%Y-%m-%d" if day.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _xlsx(z: zipfile.ZipFile) -> list[tuple[str, list[list]]]:
    names = set(z.namelist())
    tree = lambda n: ET.fromstring(z.read(n))
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in tree("xl/sharedStrings.xml").iter(f"{MAIN}si")]
    dates: set[int] = set()
    if "xl/styles.xml" in names:
        styles = tree("xl/styles.xml")
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
        formats = styles.find(f"{MAIN}cellXfs")
        dates = {i for i, xf in enumerate(formats if formats is not None else ()) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | own}
    book = tree("xl/workbook.xml")
    properties = book.find(f"{MAIN}workbookPr")
    first = datetime.datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
    links = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in book.iter(f"{MAIN}sheet"):
        target = links[sheet.get(LINK)].lstrip("/")
        rows: list[list] = []
        for row in tree(target if target.startswith("xl/") else f"xl/{target}").iter(f"{MAIN}row"):
            at = int(row.get("r", len(rows) + 1))
            rows.extend([] for _ in range(min(at - 1 - len(rows), MOST_REPEAT)))
            cells: list = []
            for c in row.iter(f"{MAIN}c"):
                i = _column(c.get("r")) if c.get("r") else len(cells)
                cells.extend([None] * (i - len(cells)))
                kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
                value = v.text if v is not None else None
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif kind == "b":
                    value = "true" if value == "1" else "false"
                elif kind == "n" and value is not None:
                    number = float(value)
                    value = date_text(first + datetime.timedelta(days=number)) if int(c.get("s", 0)) in dates else scalar_text(number)
                cells.append(value)
            rows.append(cells)
        out.append((sheet.get("name"), rows))
    return out


def _ods(z: zipfile.ZipFile) -> list[tuple[str, list[list]]]:
    out = []
    for sheet in ET.fromstring(z.read("content.xml")).iter(f"{TABLE}table"):
        rows: list[list] = []
        for row in sheet.iter(f"{TABLE}table-row"):
            cells: list = []
            for c in row:
                kind = c.get(f"{OFFICE}value-type")
                value = "\n".join("".join(p.itertext()) for p in c.iter(f"{TEXT}p")) or None
                if kind in ("float", "currency", "percentage"):
                    value = scalar_text(float(c.get(f"{OFFICE}value")))
                elif kind == "boolean":
                    value = c.get(f"{OFFICE}boolean-value")
                elif kind == "date":
                    value = date_text(datetime.datetime.fromisoformat(c.get(f"{OFFICE}date-value")))
                many = int(c.get(f"{TABLE}number-columns-repeated", 1))
                cells.extend([value] * (many if value is not None else min(many, MOST_REPEAT)))
            while cells and cells[-1] is None:
                cells.pop()
            many = int(row.get(f"{TABLE}number-rows-repeated", 1))
            rows.extend([list(cells) for _ in range(many if cells else min(many, MOST_REPEAT))])
        while rows and not rows[-1]:
            rows.pop()
        out.append((sheet.get(f"{TABLE}name"), rows))
    return out


def sheets(data: bytes | None) -> list[tuple[str, list[list]]]:
    """(name, rows) of the sheets that are not empty; cells are text or None, dates as yyyy-MM-dd[ HH:mm:ss]."""
    if not data:
        raise CodedError("TABLE_EMPTY", "there is no byte")
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise CodedError("TABLE_READ_UNSUPPORTED", "old binary workbooks, and those with a password, cannot be read")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            got = _xlsx(z) if "xl/workbook.xml" in z.namelist() else _ods(z)
    except (zipfile.BadZipFile, KeyError, ET.ParseError, OSError, ValueError, EOFError) as e:
        raise CodedError("TABLE_READ_FAILED", str(e)) from e
    got = [(n, r) for n, r in got if any(c not in (None, "") for row in r for c in row)]
    if not got:
        raise CodedError("TABLE_EMPTY", "no sheet has a filled cell")
    return got


def _rows(data, first_only: bool = False) -> list[tuple]:
    return [(name, pos, i, [None if c is None else str(c) for c in row]) for pos, (name, rows) in enumerate(sheets(data)[: 1 if first_only else None]) for i, row in enumerate(rows, 1)]


def read(df: DataFrame, content: str = "content", first_only: bool = False, mode: str = "PERMISSIVE") -> DataFrame:
    """One row for each row of each sheet: sheet, sheet_pos, row_pos, cells."""
    return explode_rows(df, lambda b: _rows(b, first_only), [content], ROW, [c for c in df.columns if c != content], mode)


def sheet_names(names: list[str | None]) -> list[str]:
    """Names a workbook takes: 31 characters, none twice; blank ones become SheetN."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        clean = re.sub(r"[\\/?*\[\]:]", "_", n or "")[:SHEET_NAME] or f"Sheet{i}"
        name, k = clean, 2
        while name in out:
            name, k = f"{clean[: SHEET_NAME - 3]}({k})", k + 1
        out.append(name)
    return out


def write_xlsx(tables: list[tuple[str | None, list[list[str | None]]]]) -> bytes:
    """A workbook of sheets; cells that read as numbers or booleans are such, columns are as wide as their widest cell."""
    names = sheet_names([n for n, _ in tables])
    out = io.BytesIO()

    def cell(c) -> str:
        v = scalar(c) if isinstance(c, str) else c
        if v is None and c in (None, ""):
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{scalar_text(v)}</v></c>"
        text = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", c))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    types, links, entries = [], [], []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, (_, rows)) in enumerate(zip(names, tables), 1):
            wide = max((len(r) for r in rows), default=0)
            cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{min(60, max([6, *(width(str(r[k])) for r in rows if k < len(r) and r[k] is not None)]) + 2)}" customWidth="1"/>' for k in range(wide))
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{MAIN[1:-1]}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{body}</sheetData></worksheet>')
            types.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
            links.append(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>')
            entries.append(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>')
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(types)}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:].split("}")[0]}"><sheets>{"".join(entries)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(links)}</Relationships>')
    return out.getvalue()


#: Names of the parts of an OpenDocument file.
ODF = "urn:oasis:names:tc:opendocument:xmlns:"
ODS_TYPE = "application/vnd.oasis.opendocument.spreadsheet"


def write_ods(tables: list[tuple[str | None, list[list[str | None]]]]) -> bytes:
    """An OpenDocument workbook of sheets; cells that read as numbers or booleans are such."""
    names = sheet_names([n for n, _ in tables])

    def cell(c) -> str:
        v = scalar(c) if isinstance(c, str) else c
        if v is None and c in (None, ""):
            return "<table:table-cell/>"
        if isinstance(v, bool):
            return f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(v).lower()}"><text:p>{str(v).upper()}</text:p></table:table-cell>'
        if isinstance(v, (int, float)):
            return f'<table:table-cell office:value-type="float" office:value="{scalar_text(v)}"><text:p>{scalar_text(v)}</text:p></table:table-cell>'
        lines = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", c)).split("\n")
        return f'<table:table-cell office:value-type="string">{"".join(f"<text:p>{x}</text:p>" for x in lines)}</table:table-cell>'

    sheets_xml = "".join(
        f'<table:table table:name="{escape(n, {chr(34): "&quot;"})}">{"".join(f"<table:table-row>{"".join(map(cell, r)) or "<table:table-cell/>"}</table:table-row>" for r in rows)}</table:table>' for n, (_, rows) in zip(names, tables)
    )
    spaces = " ".join(f'xmlns:{n}="{ODF}{n}:1.0"' for n in ("office", "table", "text"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), ODS_TYPE)  # first, and not compressed
        z.writestr("content.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<office:document-content {spaces} office:version="1.2"><office:body><office:spreadsheet>{sheets_xml}</office:spreadsheet></office:body></office:document-content>')
        entry = lambda path, kind: f'<manifest:file-entry manifest:full-path="{path}" manifest:media-type="{kind}"/>'
        z.writestr("META-INF/manifest.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<manifest:manifest xmlns:manifest="{ODF}manifest:1.0" manifest:version="1.2">{entry("/", ODS_TYPE)}{entry("content.xml", "text/xml")}</manifest:manifest>')
    return out.getvalue()


def write(grids: DataFrame, *key: str, most_rows: int = 1_048_576) -> DataFrame:
    """key, workbook: a workbook for each key from its sheets' rows.  A sheet takes `most_rows` rows, as the format does; a key
    with a longer sheet has an error instead."""
    counts = grids.groupBy(*key, "sheet").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max("n").alias("__most"))
    fits = grids.join(counts.where(F.col("__most") <= most_rows), list(key), "left_semi")
    rows = fits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("sheet_pos", "row_pos", "sheet", "cells"))).alias("__rows"))

    def run(found):
        tables: dict[int, tuple[str, list]] = {}
        for r in found:
            tables.setdefault(r["sheet_pos"], (r["sheet"], []))[1].append(r["cells"])
        return (write_xlsx([tables[k] for k in sorted(tables)]),)

    got = map_rows(rows, run, ["__rows"], "workbook binary", keep=list(key))
    late = counts.where(F.col("__most") > most_rows).select(*key, F.lit(None).cast("binary").alias("workbook"), F.lit("TABLE_TOO_LARGE").alias("error_code"), F.lit("a sheet has too many rows").alias("error_message"))
    return got.unionByName(late)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _open(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def partitions(self):
        from pyarrow import fs

        where, path = self._open()
        info = where.get_file_info(path)
        if info.type == fs.FileType.File:
            return [_File(path)]
        found = where.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".xlsx", ".ods"))]

    def read(self, partition):
        where, _ = self._open()
        with where.open_input_stream(partition.value) as f:
            data = f.read()
        for row in _rows(data, self.options.get("sheet", "all") == "first"):
            yield (partition.value, *row)


class WorkbookSource(DataSource):
    """spark.read.format("workbook").load(folder): a task a file."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return f"path string, {ROW}"

    def reader(self, schema):
        return _Reader(self.options)
