"""Word, slide and sheet files: a row-local helper reads their XML; sections come from the same windows as Markdown's."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parsing import headed_units

#: XML names of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
HEADING = re.compile(r"(?:heading|заголовок)\s*(\d)", re.I)
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
MAX_UNPACKED = 200 << 20

FIELDS = (
    "title string, author string, doc_date string, error string, "
    "lines array<struct<level: int, line: string>>, units array<struct<section: string, page: int, text: string>>"
)


class Package:
    """The XML parts of one zipped file."""

    def __init__(self, data: bytes, limit: int = MAX_UNPACKED):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if sum(i.file_size for i in self.zip.infolist()) > limit:
            raise ValueError("too large when unpacked")
        self.names = set(self.zip.namelist())

    def part(self, name: str):
        return ElementTree.fromstring(self.zip.read(name)) if name in self.names else ElementTree.Element("none")

    def targets(self, name: str) -> dict[str, tuple[str, str]]:
        """Relation id -> (last word of its type, part)."""
        folder, base = posixpath.split(name)
        found = self.part(f"{folder}/_rels/{base}.rels")
        path = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {x.get("Id"): (x.get("Type", "").rsplit("/", 1)[-1], path(x.get("Target", ""))) for x in found}

    def core(self) -> dict[str, str]:
        return {x.tag.rsplit("}", 1)[-1]: (x.text or "").strip() for x in self.part("docProps/core.xml")}


def _said(node) -> str:
    signs = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n", A + "br": "\n"}
    return "".join(x.text or "" if x.tag in (W + "t", A + "t") else signs.get(x.tag, "") for x in node.iter())


def _paragraphs(node, tag: str) -> str:
    return "\n".join(_said(p) for p in node.iter(tag)).strip()


def word_lines(pack: Package) -> tuple[str | None, list[tuple[int, str]]]:
    """First title, and (heading level or 0, line); a row of a table is one line, where equal neighbours appear once."""
    names = {s.get(W + "styleId"): s.find(W + "name").get(W + "val", "") for s in pack.part("word/styles.xml").iter(W + "style") if s.find(W + "name") is not None}
    title, lines = None, []
    for node in pack.part("word/document.xml").find(W + "body") or []:
        if node.tag == W + "p":
            style = node.find(f"{W}pPr/{W}pStyle")
            style = (names.get(style.get(W + "val"), style.get(W + "val") or "") if style is not None else "").strip().lower()
            text, heading = _said(node).strip(), HEADING.fullmatch(style)
            level = 1 if style == "title" else int(heading[1]) if heading else 0
            if level == 1 and text:
                title = title or text
            listed = not level and text and ("list" in style or "спис" in style)
            lines += [(level if text else 0, "- " + text if listed else text)] + ([(0, "")] if text and not level and not listed else [])
        elif node.tag == W + "tbl":
            for row in node.iter(W + "tr"):
                cells = [_paragraphs(c, W + "p").replace("\n", " ") for c in row.findall(W + "tc")]
                cells = [c for i, c in enumerate(cells) if i == 0 or c != cells[i - 1]]
                lines += [(0, " | ".join(cells))] if any(cells) else []
            lines.append((0, ""))
    return title, lines


def slide_units(pack: Package) -> tuple[str | None, list[tuple[str, int, str]]]:
    """First title, and a unit for each slide: its title, texts, rows of tables, notes."""
    top, first, units = "ppt/presentation.xml", None, []
    places = pack.targets(top)
    for number, ref in enumerate(pack.part(top).iter(P + "sldId"), 1):
        name = places[ref.get(R + "id")][1]
        title, parts = "", []
        for shape in pack.part(name).iter():
            if shape.tag == P + "sp":
                kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                text = _paragraphs(shape, A + "p")
                if kind is not None and kind.get("type") in ("title", "ctrTitle") and not title:
                    title = text
                elif text:
                    parts.append(text)
            elif shape.tag == A + "tbl":
                parts += [" | ".join(_paragraphs(c, A + "p") for c in row.iter(A + "tc")) for row in shape.iter(A + "tr")]
        for kind, notes in pack.targets(name).values():
            if kind == "notesSlide":
                bodies = [s for s in pack.part(notes).iter(P + "sp") if (h := s.find(f"{P}nvSpPr/{P}nvPr/{P}ph")) is not None and h.get("type") == "body"]
                parts += ["Заметки: " + t for s in bodies if (t := _paragraphs(s, A + "p"))]
        first = first or title or None
        text = "\n".join([title, *parts] if title else parts).strip()
        if text:
            units.append((f"Слайд {number}" + (f": {title}" if title else ""), number, text))
    return first, units


def _value(cell, shared: list[str], dates: set[int]) -> str:
    kind, v = cell.get("t", "n"), cell.findtext(S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(S + "t")).strip()
    if v is None:
        return ""
    if kind == "s":
        return shared[int(v)].strip()
    if kind == "b":
        return str(v == "1")
    if kind != "n":
        return v.strip()
    x = float(v)
    if int(cell.get("s", 0)) in dates:
        day = datetime(1899, 12, 30) + timedelta(seconds=round(x * 86400))
        return day.date().isoformat() if x == int(x) else day.isoformat(sep=" ")
    return str(int(x)) if x.is_integer() else str(x)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_units(pack: Package) -> list[tuple[str, int, str]]:
    """A unit for each sheet with rows: its first row gives the names, each other row is `name: value` pairs."""
    shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in pack.part("xl/sharedStrings.xml").iter(S + "si")]
    styles = pack.part("xl/styles.xml")
    own = {int(f.get("numFmtId")) for f in styles.iter(S + "numFmt") if re.search("[ydh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    formats = styles.find(S + "cellXfs")
    dates = {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
    places, units = pack.targets("xl/workbook.xml"), []
    for number, sheet in enumerate(pack.part("xl/workbook.xml").iter(S + "sheet"), 1):
        header: dict[int, str] | None = None
        lines: list[str] = []
        for row in pack.part(places[sheet.get(R + "id")][1]).iter(S + "row"):
            cells = {(_column(c.get("r")) if c.get("r") else i): _value(c, shared, dates) for i, c in enumerate(row.findall(S + "c"))}
            cells = {i: v for i, v in sorted(cells.items()) if v}
            if cells and header is None:
                header = cells
                lines.append(" | ".join(cells.values()))
            elif cells:
                lines.append("; ".join(f"{header.get(i) or f'Столбец {i + 1}'}: {v}" for i, v in cells.items()))
        if lines:
            units.append((f"Лист «{sheet.get('name')}»", number, "\n".join(lines)))
    return units


def read_office(data: bytes | None, kind: str) -> dict:
    """One file as a row of FIELDS; what can't be read gives an error, never a failed job."""
    out = dict.fromkeys(("title", "author", "doc_date", "error")) | {"lines": [], "units": []}
    try:
        pack = Package(data or b"")
        core, title = pack.core(), None
        if kind == "docx":
            title, lines = word_lines(pack)
            out["lines"] = [{"level": n, "line": t} for n, t in lines]
        else:
            title, units = slide_units(pack) if kind == "pptx" else (None, sheet_units(pack))
            out["units"] = [{"section": s, "page": p, "text": t} for s, p, t in units]
        date = core.get("modified") or core.get("created") or ""
        out |= {"title": core.get("title") or title, "author": core.get("creator") or None, "doc_date": date[:10] or None}
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError, OverflowError, RuntimeError, NotImplementedError) as e:
        out["error"] = f"{type(e).__name__}: {e}"[:500]
    return out


def office_files(files: DataFrame, key: str = "path", kind: str = "kind", content: str = "content") -> DataFrame:
    """key, kind and FIELDS for the docx, pptx and xlsx rows of ``files``; ``lines`` is for docx, ``units`` for the others."""
    rows = files.where(F.col(kind).isin("docx", "pptx", "xlsx")).select(key, F.col(kind).alias("kind"), F.col(content).alias("content"))
    given = f"{key} {rows.schema[key].dataType.simpleString()}, kind string, "

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, unit = pa.struct([("level", pa.int32()), ("line", pa.string())]), pa.struct([("section", pa.string()), ("page", pa.int32()), ("text", pa.string())])
        types = [pa.string()] * 4 + [pa.list_(line), pa.list_(unit)]
        for b in batches:
            read = [read_office(data, k) for data, k in zip(b["content"].to_pylist(), b["kind"].to_pylist(), strict=True)]
            names = ["title", "author", "doc_date", "error", "lines", "units"]
            yield pa.RecordBatch.from_arrays([b[key], b["kind"], *(pa.array([r[n] for r in read], t) for n, t in zip(names, types, strict=True))], names=[key, "kind", *names])

    return rows.mapInArrow(run, given + FIELDS)


def office_units(read: DataFrame, key: str = "path") -> DataFrame:
    """key, unit, section, page, text from :func:`office_files`: headings cut Word files, slides and sheets are units as they are."""
    lines = read.where("kind = 'docx'").select(key, F.posexplode("lines").alias("at", "x")).select(key, "at", "x.line", "x.level", F.col("x.line").alias("title"))
    word = headed_units(lines, key).select(key, "unit", "section", F.lit(None).cast("int").alias("page"), "text")
    rest = read.where("kind <> 'docx'").select(key, F.posexplode("units").alias("unit", "x")).select(key, "unit", "x.section", "x.page", "x.text")
    return word.unionByName(rest)
