"""Delimited text, read strictly."""

from __future__ import annotations

import re

from ledgerloom.sources.decode import decode_text
from ledgerloom.sources.elements import Element, Malformed, Parsed, column_letters

SHEET, SNIFFED_LINES = "CSV", 5
_QUOTED = re.compile(r'"(?:[^"]|"")*"')
#: One field and what ends it: a quoted field, or one without quotes.
_FIELD = {d: re.compile(rf'(?:"((?:[^"]|"")*)"|([^"{re.escape(d)}\r\n][^{re.escape(d)}\r\n]*)?)({re.escape(d)}|\r\n|\r|\n|\Z)') for d in (",", ";", "\t")}


def sniff_delimiter(text: str) -> str:
    """A semicolon, if the first lines all hold equally many outside quotes, and more than any holds commas; else a comma."""
    lines = [_QUOTED.sub("", x) for x in re.split(r"\r\n|\r|\n", text) if x][:SNIFFED_LINES]
    counts = {x.count(";") for x in lines}
    return ";" if len(counts) == 1 and (n := counts.pop()) > 0 and n > max(x.count(",") for x in lines) else ","


def rows_of(text: str, delimiter: str) -> list[list[str]]:
    """Rows of fields.  A quote inside an unquoted field, text after a closing quote, or a quote left open is an error."""
    rows, row, at = [], [], 0
    while at < len(text) or row:
        m = _FIELD[delimiter].match(text, at)
        if not m:
            raise Malformed(f"a quote out of place, or one left open, at character {at}")
        plain = m[2] or ""
        if '"' in plain:
            raise Malformed(f"a quote inside an unquoted field at character {at}")
        row.append(m[1].replace('""', '"') if m[1] is not None else plain)
        at = m.end()
        if m[3] != delimiter:
            rows.append(row)
            row = []
            if not m[3]:
                break
    return rows


def parse_delimited(content: bytes, delimiter: str | None = None) -> Parsed:
    """One element per cell that is not blank, addressed A1."""
    text, encoding = decode_text(content)
    rows = rows_of(text, delimiter or sniff_delimiter(text))
    cells = [Element(v, "xlsx-cell", sheet_name=SHEET, cell=f"{column_letters(c)}{r}") for r, row in enumerate(rows, 1) for c, v in enumerate(row) if v.strip()]
    return Parsed(cells, [] if encoding == "utf-8" else [f"decoded as {encoding}"])
