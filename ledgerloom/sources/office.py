"""Office Open XML files, read from their zipped parts."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from ledgerloom.sources.elements import Element, Malformed, Parsed, column_letters

# Limits on archives and sheets.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_BYTES, MOST_MERGED, MOST_CELLS, MOST_SHEET_BYTES = 2_000, 200 * 2**20, 500 * 2**20, 5_000, 200_000, 25 * 2**20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates, percentages and grouped numbers.
_DATES = frozenset((14, 15, 16, 17, 22))
_BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%"}


def open_archive(content: bytes) -> zipfile.ZipFile:
    """The archive, if it is safe: not too many or too large entries, none that leads outside."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Malformed("no archive") from e
    infos = z.infolist()
    if len(infos) > MOST_ENTRIES or any(i.file_size > MOST_ENTRY_BYTES for i in infos) or sum(i.file_size for i in infos) > MOST_BYTES:
        raise Malformed("the archive is too large")
    for i in infos:
        if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename) or ":" in i.filename:
            raise Malformed("an entry leads outside the archive")
    return z


def _xml(z: zipfile.ZipFile, name: str, most: int = MOST_ENTRY_BYTES) -> ET.Element:
    try:
        with z.open(name) as f:
            data = f.read(most + 1)
    except KeyError as e:
        raise Malformed(f"{name} is missing") from e
    if len(data) > most:
        raise Malformed(f"{name} is too large")
    if b"<!DOCTYPE" in data[:4096].upper():
        raise Malformed("document types are refused")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise Malformed(f"{name} is no XML") from e


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, base = posixpath.split(part)
    rels = _xml(z, f"{folder}/_rels/{base}.rels")
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") if not r.get("Target", "").startswith("/") else r.get("Target").lstrip("/") for r in rels if r.get("TargetMode") != "External"}


def parse_docx(content: bytes) -> Parsed:
    """Paragraphs with their heading path, from HeadingN styles."""
    out, trail = [], []
    body = _xml(open_archive(content), "word/document.xml")
    for i, p in enumerate(body.iter(f"{_W}p")):
        text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"Heading([1-9])", style.get(f"{_W}val", "")) if style is not None else None
        if not text.strip():
            continue
        if level:
            trail = [*trail[: int(level[1]) - 1], text.strip()]
        out.append(Element(text, "docx-paragraph", tuple(trail), paragraph_index=i))
    return Parsed(out)


def parse_pptx(content: bytes) -> Parsed:
    """One element per slide, in the order of the presentation."""
    z = open_archive(content)
    deck = _xml(z, "ppt/presentation.xml")
    targets = _targets(z, "ppt/presentation.xml")
    ids = [e.get(f"{_R}id") for e in deck.iter() if e.tag.endswith("}sldId")]
    out = []
    for n, rid in enumerate(ids, 1):
        paragraphs = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in _xml(z, targets[rid]).iter(f"{_A}p")]
        if text := "\n".join(p for p in paragraphs if p.strip()):
            out.append(Element(text, "pptx-slide", slide=n))
    return Parsed(out)


def format_number(value: float, pattern: str) -> tuple[str, bool]:
    """(text, whether the format was understood) of a number in a spreadsheet format of up to four sections."""
    sections = pattern.split(";")
    chosen = sections[1] if value < 0 and len(sections) > 1 else sections[2] if value == 0 and len(sections) > 2 else sections[0]
    literal_sign = value < 0 and len(sections) > 1
    plain = re.sub(r"\[[^\]]*\]|_.|\*.", "", chosen)
    m = re.search(r"[#0,]*[#0](?:\.[#0]+)?,*", plain)
    if plain.lower() == "general":
        return f"{value:.15g}", True
    if not m or re.search(r"[ymdhsEe@?/]", re.sub(r'"[^"]*"|\\.', "", plain)):
        return f"{value:.15g}", False
    digits = m[0]
    scale = len(digits) - len(digits.rstrip(","))
    whole, _, fraction = digits.rstrip(",").partition(".")
    size = abs(value) * (100 if "%" in plain else 1) / 1000**scale
    text = f"{size:{',' if ',' in whole else ''}.{len(fraction)}f}"
    if "#" in fraction:
        keep = fraction.rstrip("#").count("0")
        head, _, tail = text.partition(".")
        tail = tail[:keep] + tail[keep:].rstrip("0")
        text = head + ("." + tail if tail else "")
    bare = lambda t: re.sub(r"\\(.)", r"\1", t.replace('"', ""))
    body = bare(plain[: m.start()]) + text + bare(plain[m.end() :])
    return ("-" if value < 0 and not literal_sign else "") + body, True


def parse_xlsx(content: bytes) -> Parsed:
    """One element per displayed cell that is not blank; merged ranges repeat their first cell's text."""
    z = open_archive(content)
    names = set(z.namelist())
    strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in _xml(z, "xl/sharedStrings.xml").findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
    formats: dict[int, tuple[int, str]] = {}
    if "xl/styles.xml" in names:
        styles = _xml(z, "xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "General") for f in styles.iter(f"{_S}numFmt")}
        for i, xf in enumerate(styles.findall(f"{_S}cellXfs/{_S}xf")):
            n = int(xf.get("numFmtId", 0))
            formats[i] = (n, own.get(n, _BUILT_IN.get(n, "General")))
    book, targets = _xml(z, "xl/workbook.xml"), _targets(z, "xl/workbook.xml")
    day_zero = dt.date(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_S}workbookPr")) else dt.date(1899, 12, 30)
    out, reasons = [], set()
    for sheet in book.iter(f"{_S}sheet"):
        root = _xml(z, targets[sheet.get(f"{_R}id")], MOST_SHEET_BYTES)
        texts: dict[str, str] = {}
        for c in root.iter(f"{_S}c"):
            v, kind = c.find(f"{_S}v"), c.get("t", "n")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                text = strings[int(v.text)]
            elif kind == "b":
                text = "TRUE" if v.text == "1" else "FALSE"
            elif kind in ("str", "e", "d"):
                text = v.text
            else:
                n, pattern = formats.get(int(c.get("s", 0)), (0, "General"))
                if n in _DATES or (n >= 164 and re.search(r"[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", pattern))):
                    text = (day_zero + dt.timedelta(days=int(float(v.text)))).isoformat()
                else:
                    text, known = format_number(float(v.text), pattern)
                    if not known:
                        reasons.add(f"number format {pattern} is shown as the plain value")
            if text.strip():
                texts[c.get("r")] = text
        covered = {}
        for m in root.iter(f"{_S}mergeCell"):
            a, b = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", m.get("ref")).group(1, 2), re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", m.get("ref")).group(3, 4)
            number = lambda s: sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(s)))
            columns, rows = range(number(a[0]), number(b[0]) + 1), range(int(a[1]), int(b[1]) + 1)
            if len(columns) * len(rows) > MOST_MERGED:
                raise Malformed("a merged range is too large")
            if first := texts.get("".join(a)):
                covered |= {f"{column_letters(c - 1)}{r}": first for c in columns for r in rows if f"{column_letters(c - 1)}{r}" != "".join(a)}
        for cell, text in {**texts, **covered}.items():
            out.append(Element(text, "xlsx-cell", sheet_name=sheet.get("name"), cell=cell, merge_covered=cell in covered))
        if len(out) > MOST_CELLS:
            raise Malformed("too many cells")
    return Parsed(out, sorted(reasons))
