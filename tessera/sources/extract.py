"""Files to text units: dispatch by type, readers for text and office formats, and the paragraph chunker."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import SPACES, suffix

# Formats by file type and by MIME type.
SUFFIXES = ("pdf", "docx", "pptx", "xlsx", "txt", "md")
MIME = {
    "application/pdf": "pdf", "text/plain": "txt", "text/markdown": "md",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}
SECTION_WORDS = 150
_UNIT = "filename string, format string, page_number int, source_type string, content string, error string"


def dispatch(filename: Column | str, mime: Column | str | None = None) -> Column:
    """Format by file type; the MIME type counts only where there is no file type; null if neither is known."""
    kind = suffix(filename)
    by_mime = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[F.col(mime) if isinstance(mime, str) else mime] if mime is not None else F.lit(None).cast("string")
    return F.when(kind.isin(*SUFFIXES), kind).when(kind == "", by_mime)


def decode_text(data: bytes) -> str:
    """UTF-8, else Windows-1252 with replacement; NULs removed."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    return text.replace("\x00", "")


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ElementTree.Element | None, name: str) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _child(e: ElementTree.Element | None, *path: str) -> ElementTree.Element | None:
    for name in path:
        e = None if e is None else next((c for c in e if _tag(c) == name), None)
    return e


def markdown_table(rows: list[list[str]]) -> str:
    """First row as heading; cells cleaned of bars and line breaks; short rows padded."""
    width = max(map(len, rows), default=0)
    clean = [[re.sub(r"\s+", " ", c).replace("|", "\\|").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if rows else ""


# Signs of roman numerals, largest first.
_ROMAN = "1000 m 900 cm 500 d 400 cd 100 c 90 xc 50 l 40 xl 10 x 9 ix 5 v 4 iv 1 i".split()


def _roman(n: int) -> str:
    steps = zip(map(int, _ROMAN[::2]), _ROMAN[1::2])
    text = ""
    for value, sign in steps:
        count, n = divmod(n, value)
        text += sign * count
    return text


#: How the formats of the office standard write a number; those not named write plain digits.
NUMBER_FORMATS = {
    "lowerLetter": lambda n: chr(97 + (n - 1) % 26) * (1 + (n - 1) // 26) if n > 0 else "",
    "upperLetter": lambda n: NUMBER_FORMATS["lowerLetter"](n).upper(),
    "lowerRoman": _roman,
    "upperRoman": lambda n: _roman(n).upper(),
    "decimalZero": lambda n: str(n).zfill(2),
}


class Outline:
    """Where a numbered list stands: the numbers of its levels down to the last one used."""

    def __init__(self):
        self.at: list[int] = []
        self.restarts: dict[int, int] = {}

    def restart(self, level: int, number: int) -> None:
        """The next paragraph at ``level`` gets ``number``."""
        self.restarts[level] = number

    def step(self, level: int, start: Callable[[int], int]) -> list[int]:
        """Number a paragraph at ``level``: levels above it that were not used begin, levels below it end."""
        while len(self.at) < level:
            self.at.append(self.restarts.pop(len(self.at), start(len(self.at))))
        used = self.at[level] + 1 if len(self.at) > level else start(level)
        self.at[level:] = [self.restarts.pop(level, used)]
        return self.at


class Numbering:
    """List labels of a word-processing document, which hold in its numbering part and styles but not in its text."""

    def __init__(self, numbering: ElementTree.Element | None, styles: ElementTree.Element | None):
        parts = list(numbering) if numbering is not None else []
        tables = {_attr(e, "abstractNumId"): {int(_attr(x, "ilvl") or 0): x for x in e if _tag(x) == "lvl"} for e in parts if _tag(e) == "abstractNum"}
        self.lists: dict[str, tuple[str | None, dict, dict[int, int]]] = {}
        for e in (e for e in parts if _tag(e) == "num"):
            family = _attr(_child(e, "abstractNumId"), "val")
            changed, restarts = dict(tables.get(family, {})), {}
            for o in (o for o in e if _tag(o) == "lvlOverride"):
                level, own, start = int(_attr(o, "ilvl") or 0), _child(o, "lvl"), _attr(_child(o, "startOverride"), "val")
                if own is not None:
                    changed[level] = own
                if start is not None:
                    restarts[level] = int(start)
            self.lists[_attr(e, "numId") or ""] = (family, changed, restarts)
        self.styles = {_attr(e, "styleId"): e for e in (styles if styles is not None else ()) if _tag(e) == "style"}
        self.outlines: dict[str | None, Outline] = {}
        self.begun: set[str] = set()

    def style_name(self, style: str | None) -> str:
        return (_attr(_child(self.styles.get(style), "name"), "val") or style or "").lower()

    def place(self, paragraph: ElementTree.Element) -> tuple[str, int] | None:
        """(list, level) of a paragraph, by its own properties or else by the nearest style it is based on that has them."""
        holder, seen = _child(paragraph, "pPr"), set()
        style = _attr(_child(holder, "pStyle"), "val")
        while True:
            name = _attr(_child(holder, "numPr", "numId"), "val")
            if name is not None:
                return name, int(_attr(_child(holder, "numPr", "ilvl"), "val") or 0)
            if style is None or style in seen or style not in self.styles:
                return None
            seen.add(style)
            holder, style = _child(self.styles[style], "pPr"), _attr(_child(self.styles[style], "basedOn"), "val")

    def label(self, paragraph: ElementTree.Element) -> str:
        """The label of the next paragraph in the order of the document; empty if it has none."""
        found = self.place(paragraph)
        if found is None or found[0] not in self.lists:
            return ""
        name, level = found
        family, levels, restarts = self.lists[name]
        if level not in levels:
            return ""
        value = lambda at, what, default: (_attr(_child(levels.get(at), what), "val") or default)
        outline = self.outlines.setdefault(family, Outline())
        if name not in self.begun:
            self.begun.add(name)
            for at, number in restarts.items():
                outline.restart(at, number)
        numbers = outline.step(level, lambda at: int(value(at, "start", "1")))
        kind, template = value(level, "numFmt", "decimal"), value(level, "lvlText", "")
        if kind == "bullet":
            return "-"
        if kind == "none":
            return template.strip()
        plain_digits = _child(levels[level], "isLgl") is not None
        for at, number in enumerate(numbers):
            written_as = NUMBER_FORMATS.get("decimal" if plain_digits else value(at, "numFmt", "decimal"), str)
            template = template.replace(f"%{at + 1}", written_as(number))
        return template.strip()


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(z.read(name))
    except KeyError:
        return None


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in root if root is not None else ():
        target = r.attrib.get("Target", "")
        out[r.attrib.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return out


def _run_text(e: ElementTree.Element) -> str:
    """Text with insertions kept and deletions dropped."""
    if _tag(e) in ("del", "moveFrom", "pPr", "rPr"):
        return ""
    own = (e.text or "") if _tag(e) == "t" else "\t" if _tag(e) == "tab" else "\n" if _tag(e) in ("br", "cr") else ""
    return own + "".join(_run_text(c) for c in e)


def read_docx(data: bytes) -> list[tuple[int, str, str]]:
    """Sections of paragraphs, a new one at a heading or after enough words, then the tables; numbered by paragraph and table."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = _child(_xml(z, "word/document.xml"), "body")
    numbering = Numbering(_xml(z, "word/numbering.xml"), _xml(z, "word/styles.xml"))
    labels = {p: numbering.label(p) for p in body.iter() if _tag(p) == "p"} if body is not None else {}

    def text_of(p: ElementTree.Element) -> str:
        text = re.sub(r"\n\s*\n", "\n", _run_text(p)).strip()
        return f"{labels[p]} {text}".strip() if text else ""

    sections: list[tuple[int, list[str]]] = []
    words = 0
    for no, p in enumerate(e for e in body if _tag(e) == "p") if body is not None else ():
        text = text_of(p)
        if not text:
            continue
        heading = numbering.style_name(_attr(_child(p, "pPr", "pStyle"), "val")).startswith(("heading", "title"))
        if not sections or heading or words >= SECTION_WORDS:
            sections.append((no, []))
            words = 0
        sections[-1][1].append(text)
        words += len(text.split())
    units = [(no, "text", "\n".join(lines)) for no, lines in sections]
    for no, table in enumerate(e for e in body if _tag(e) == "tbl") if body is not None else ():
        rows = [["\n".join(filter(None, map(text_of, (p for p in c.iter() if _tag(p) == "p")))) for c in r if _tag(c) == "tc"] for r in table if _tag(r) == "tr"]
        if any(any(r) for r in rows):
            units.append((no, "text", markdown_table(rows)))
    return units


def _cached(root: ElementTree.Element | None) -> list[str]:
    """Cached points of a chart reference, in order of their index."""
    points = {}
    for p in root.iter() if root is not None else ():
        if _tag(p) == "pt":
            v = _child(p, "v")
            points[int(_attr(p, "idx") or 0)] = (v.text or "") if v is not None else ""
    return [points.get(i, "") for i in range(max(points) + 1)] if points else []


def chart_table(root: ElementTree.Element) -> str:
    """The series of a chart part as a table of categories and values."""
    series = [s for s in root.iter() if _tag(s) == "ser"]
    if not series:
        return ""
    heads = [""] + [" ".join(_cached(_child(s, "tx"))) or f"Series {i}" for i, s in enumerate(series, 1)]
    categories = next((c for c in (_cached(_child(s, "cat")) for s in series) if c), [])
    values = [_cached(_child(s, "val")) for s in series]
    n = max([len(categories), *map(len, values)])
    at = lambda c, i: c[i] if i < len(c) else ""
    return markdown_table([heads, *([at(categories, i), *(at(v, i) for v in values)] for i in range(n))])


def _charts(z: zipfile.ZipFile, relations: dict[str, str]) -> Iterator[str]:
    for target in relations.values():
        if "/charts/chart" in target or target.startswith("charts/chart"):
            root = _xml(z, target)
            table = chart_table(root) if root is not None else ""
            if table:
                yield table


def read_pptx(data: bytes) -> list[tuple[int, str, str]]:
    """A unit a slide with its speaker notes, and one for each native chart."""
    z = zipfile.ZipFile(io.BytesIO(data))
    part = "ppt/presentation.xml"
    relations = _relations(z, part)
    root = _xml(z, part)
    order = [_attr(s, "id") for s in root.iter() if _tag(s) == "sldId"] if root is not None else []
    ids = [next((v for k, v in s.attrib.items() if k.endswith("}id")), None) for s in root.iter() if _tag(s) == "sldId"] if root is not None else []
    units = []
    for no, rid in enumerate(ids or order, 1):
        name = relations.get(rid or "")
        slide = _xml(z, name) if name else None
        if slide is None:
            continue
        mine = _relations(z, name)

        def text_of(e: ElementTree.Element) -> str:
            lines = ["".join(t.text or "" for t in p.iter() if _tag(t) == "t") for body in e.iter() if _tag(body) == "txBody" for p in body if _tag(p) == "p"]
            return "\n".join(x for x in (line.strip() for line in lines) if x)

        parts = [text_of(slide)]
        for target in mine.values():
            if "notesSlide" in target:
                notes = _xml(z, target)
                spoken = "\n".join(x for x in text_of(notes).split("\n") if not x.isdigit()) if notes is not None else ""
                if spoken:
                    parts.append(f"[Speaker notes] {spoken}")
        if any(parts):
            units.append((no, "text", "\n".join(p for p in parts if p)))
        units += [(no, "chart_data", t) for t in _charts(z, mine)]
    return units


# Built-in number formats that show a date or time.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or time."""
    root = _xml(z, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(_attr(f, "numFmtId") or 0) for f in root.iter() if _tag(f) == "numFmt" and re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", (_attr(f, "formatCode") or "").lower()))}
    cells = _child(root, "cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(_attr(x, "numFmtId") or 0) in _DATE_FORMATS | own}


def _cell_text(raw: str, kind: str | None, dated: bool, first_day: datetime) -> str:
    """What a cell shows of its stored value: dates as dates, truth values as words, whole numbers without a fraction."""
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind not in (None, "n") or not raw:
        return raw
    try:
        number = float(raw)
        if dated:
            return str(first_day + timedelta(seconds=round(number * 86_400)))
        return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)
    except (ValueError, OverflowError):
        return raw


def read_xlsx(data: bytes) -> list[tuple[int, str, str]]:
    """A unit a sheet that is not empty, and one for each chart from its cached ranges."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = _xml(z, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in shared if _tag(s) == "si"] if shared is not None else []
    relations = _relations(z, "xl/workbook.xml")
    book = _xml(z, "xl/workbook.xml")
    dates = _date_styles(z)
    first_day = datetime(1904, 1, 1) if book is not None and _attr(_child(book, "workbookPr"), "date1904") in ("1", "true") else datetime(1899, 12, 30)
    units = []
    for no, sheet in enumerate((s for s in book.iter() if _tag(s) == "sheet") if book is not None else (), 1):
        name = relations.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), "")
        root = _xml(z, name) if name else None
        if root is None:
            continue
        rows = []
        for row in (r for r in root.iter() if _tag(r) == "row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(x for x in row if _tag(x) == "c"):
                letters = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                at = sum((ord(ch) - 64) * 26**p for p, ch in enumerate(reversed(letters[0]))) - 1 if letters else i
                kind, v = c.attrib.get("t"), _child(c, "v")
                raw = "".join(t.text or "" for t in c.iter() if _tag(t) == "t") if kind == "inlineStr" else (v.text or "") if v is not None else ""
                if kind == "s":
                    cells[at] = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else raw
                else:
                    cells[at] = _cell_text(raw, kind, int(c.attrib.get("s", "0") or 0) in dates, first_day)
            if any(x.strip() for x in cells.values()):
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
        if rows:
            units.append((no, "text", f"Sheet: {sheet.attrib.get('name', '')}\n{markdown_table(rows)}"))
        for target in _relations(z, name).values():
            if "drawing" in target:
                units += [(no, "chart_data", t) for t in _charts(z, _relations(z, target))]
    return units


def read_pdf(data: bytes) -> list[tuple[int, str, str]]:
    """A unit a page that has text; needs a PDF library, which is optional."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs the optional library pypdf") from e
    pages = PdfReader(io.BytesIO(data)).pages
    return [(i, "text", t) for i, t in enumerate((p.extract_text() or "" for p in pages), 1) if t.strip()]


# Fixed value: images smaller than this on a side are icons or rules.
MIN_IMAGE_SIDE = 120


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG, GIF, JPEG or BMP; None for what is none of them."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM" and len(data) >= 26:
        return int.from_bytes(data[18:22], "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark in range(0xC0, 0xD0) and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 if mark in range(0xD0, 0xD9) or mark == 0x01 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def worth_captioning(data: bytes) -> bool:
    size = image_size(data)
    return size is not None and min(size) >= MIN_IMAGE_SIDE


def read_images(kind: str, data: bytes) -> list[tuple[int, bytes]]:
    """(page, bytes) of the images in an office file: of slides by their number, else by the order of their parts."""
    if kind == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError:
            return []
        return [(no, image.data) for no, page in enumerate(PdfReader(io.BytesIO(data)).pages, 1) for image in page.images]
    if kind not in ("docx", "pptx", "xlsx"):
        return []
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    if kind == "pptx":
        relations, root = _relations(z, "ppt/presentation.xml"), _xml(z, "ppt/presentation.xml")
        slides = [relations.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "") for s in root.iter() if _tag(s) == "sldId"] if root is not None else []
        return [(no, z.read(t)) for no, slide in enumerate(slides, 1) if slide for t in _relations(z, slide).values() if "/media/" in t and t in names]
    if kind == "docx":
        return [(no, z.read(t)) for no, t in enumerate(_relations(z, "word/document.xml").values()) if "media/" in t and t in names]
    return [(no, z.read(n)) for no, n in enumerate(sorted(n for n in names if n.startswith("xl/media/")))]


def extract_images(files: DataFrame) -> DataFrame:
    """``(filename, image_no, page_number, sha256, data)`` of the images in ``files`` (filename, format, data) that are worth a caption."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for name, kind, data in zip(b.filename, b.format, b.data):
                try:
                    found = [(page, x) for page, x in read_images(kind or "", bytes(data)) if worth_captioning(x)]
                except Exception:  # a damaged file has no images
                    found = []
                rows += [(name, i, page, hashlib.sha256(x).hexdigest(), x) for i, (page, x) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["filename", "image_no", "page_number", "sha256", "data"])

    return files.select("filename", "format", "data").filter("data is not null").mapInPandas(run, "filename string, image_no int, page_number int, sha256 string, data binary")


def dispatch_name(filename: str, mime: str | None = None) -> str | None:
    """:func:`dispatch` for one name."""
    base = filename.rsplit("/", 1)[-1]
    kind = base.rpartition(".")[2].lower() if "." in base else ""
    return kind if kind in SUFFIXES else MIME.get(mime or "") if not kind else None


def read_file(kind: str, data: bytes) -> list[tuple[int | None, str, str]]:
    readers = {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "pdf": read_pdf}
    if kind in readers:
        found = readers[kind](data)
    else:
        text = decode_text(data)
        found = [(None, "text", text)] if text.strip() else []
    return [(p, k, t.replace("\x00", "")) for p, k, t in found]


def extract(files: DataFrame) -> DataFrame:
    """Text units of ``files`` (filename, format, data); one row with ``error`` for a file that cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for name, kind, data in zip(b.filename, b.format, b.data):
                try:
                    if kind is None or data is None:
                        raise ValueError("unsupported file type")
                    rows += [(name, kind, page, what, text, None) for page, what, text in read_file(kind, bytes(data))]
                except Exception as e:  # a damaged file must not end the job
                    rows.append((name, kind, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            out = pd.DataFrame(rows, columns=["filename", "format", "page_number", "source_type", "content", "error"])
            out["page_number"] = out.page_number.astype("Int32")
            yield out

    return files.select("filename", "format", "data").mapInPandas(run, _UNIT)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, format, data)`` of the supported files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("filename"), dispatch("path").alias("format"), F.col("content").alias("data")).filter("format is not null")


def chunk_text(units: DataFrame, text: str, most: int = 500) -> DataFrame:
    """Adds ``chunk_no`` from 0 and ``chunk``: paragraphs with white space collapsed, longer ones in windows of ``most`` words.

    Paragraphs are parted by blank lines; empty ones are dropped, null texts give none.
    """
    paragraphs = F.split(F.col(text), r"\n[ \t\r\x{b}\x{c}]*\n[ \t\r\n\x{b}\x{c}]*")
    words = F.transform(paragraphs, lambda p: F.filter(F.split(p, SPACES), lambda w: w != ""))
    pieces = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(most)), lambda i: F.array_join(F.slice(w, i + 1, most), " "))))
    return units.select("*", F.posexplode(F.filter(pieces, lambda p: p != "")).alias("chunk_no", "chunk"))
