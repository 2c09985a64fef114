"""Plain text, Markdown and HTML."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from ledgerloom.sources.decode import decode_text
from ledgerloom.sources.elements import Element, Malformed, Parsed, column_letters

_HEADING = re.compile(r"(#{1,6}) (.*)")

# Limits, tags whose content is dropped, and tags that make blocks.
HTML_BYTES, HTML_ELEMENTS, HTML_DEPTH = 32 * 1024 * 1024, 150_000, 60_000
DROPPED = frozenset("script style template noscript iframe object embed head textarea title xmp noembed noframes plaintext".split())
BLOCKS = frozenset("p div section article header footer main aside blockquote pre li dt dd figcaption caption address h1 h2 h3 h4 h5 h6 td th tr".split())
#: Tags whose start ends an open one of these, up to the next enclosing list or table.
ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "p": ("p",)}
ENCLOSING = frozenset("table ul ol dl".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe")


def parse_text(content: bytes) -> Parsed:
    """Blocks between blank lines.  A block of one line that is a heading sets the heading trail, its own included."""
    text, encoding = decode_text(content)
    blocks = [b.strip("\n") for b in re.split(r"\n(?:[^\S\n]*\n)+", "\n" + text.replace("\r\n", "\n") + "\n") if b.strip()]
    trail: list[str] = []
    out = []
    for i, block in enumerate(blocks):
        m = _HEADING.fullmatch(block)
        if m:
            trail = [*trail[: len(m[1]) - 1], m[2]]
        out.append(Element(m[2] if m else block, "text-block", tuple(trail), block_index=i))
    return Parsed(out, [] if encoding == "utf-8" else [f"decoded as {encoding}"])


def _hidden(tag: str, attrs: dict[str, str | None]) -> bool:
    style = re.sub(r"\s+", "", (attrs.get("style") or "").lower())
    return "hidden" in attrs or "display:none" in style or "visibility:hidden" in style or (tag == "input" and (attrs.get("type") or "").lower() == "hidden")


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int]]] = []
        self.odd = False  # spans over rows, or another table inside


class _Walker(HTMLParser):
    """Collects blocks and tables without recursion."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Element] = []
        self.reasons: list[str] = []
        self.trail: list[tuple[int, str]] = []
        self.buffer: list[str] = []
        self.open: list[tuple[str, bool]] = []  # tag, and whether it drops its content
        self.dropping = 0
        self.tables: list[_Table] = []
        self.span = 1
        self.n_tables = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        drops = tag in DROPPED or _hidden(tag, a)
        if tag == "br" and not self.dropping:
            self.buffer.append("\n")
        if tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in ENDS.get(tag, ()):
                self.handle_endtag(self.open[i][0])
                break
            if self.open[i][0] in ENCLOSING or tag not in ENDS:
                break
        if len(self.open) >= HTML_DEPTH:
            raise Malformed("nesting is too deep")
        if not self.dropping and not drops and (tag in BLOCKS or tag == "table"):
            self._flush(None)
            if tag == "table":
                if self.tables:
                    self.tables[-1].odd = True
                self.tables.append(_Table())
            elif self.tables and tag == "tr":
                self.tables[-1].rows.append([])
            elif self.tables and tag in ("td", "th"):
                self.span = int(a["colspan"]) if (a.get("colspan") or "").isdigit() and int(a["colspan"]) > 0 else 1
                self.tables[-1].odd |= (a.get("rowspan") or "1").strip() not in ("", "1")
        self.open.append((tag, drops))
        self.dropping += drops

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        while len(self.open) > at:  # what is still open inside ends with it
            inner, drops = self.open.pop()
            was = self.dropping
            self.dropping -= drops
            if was:
                continue
            if inner in BLOCKS:
                self._flush(inner)
            elif inner == "table" and self.tables:
                self._flush(None)
                self._end_table(self.tables.pop())

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.buffer.append(data)

    def _flush(self, tag: str | None) -> None:
        text = re.sub(r"[ \t\r\n\f]+", " ", "".join(self.buffer)).strip()
        self.buffer = []
        if self.tables:
            if tag in ("td", "th") and self.tables[-1].rows:
                self.tables[-1].rows[-1].append((text, self.span))
                self.span = 1
            elif text:
                self.buffer = [text + " "]
            return
        if not text:
            return
        if tag and re.fullmatch("h[1-6]", tag):
            level = int(tag[1])
            self.trail = [*[t for t in self.trail if t[0] < level], (level, text)]
        self._emit(Element(text, "text-block", tuple(t for _, t in self.trail), block_index=len(self.out)))

    def _emit(self, element: Element) -> None:
        if len(self.out) >= HTML_ELEMENTS:
            raise Malformed("too many elements")
        self.out.append(element)

    def _end_table(self, table: _Table) -> None:
        rows = [r for r in table.rows if r]
        if self.tables:  # an inner table becomes text of the outer cell
            self.buffer.append(" ".join(t for r in rows for t, _ in r) + " ")
            return
        widths = {sum(s for _, s in r) for r in rows}
        path = tuple(t for _, t in self.trail)
        if len(rows) >= 2 and not table.odd and len(widths) == 1:
            self.n_tables += 1
            for r, row in enumerate(rows, 1):
                c = 0
                for text, span in row:
                    if text:
                        self._emit(Element(text, "xlsx-cell", path, sheet_name=f"HTML-TABLE-{self.n_tables}", cell=f"{column_letters(c)}{r}"))
                    c += span
            return
        self.reasons.append("a table whose rows do not line up was read as text")
        for row in rows:
            if text := "\t".join(t for t, _ in row).strip():
                self._emit(Element(text, "text-block", path, block_index=len(self.out)))


def parse_html(content: bytes) -> Parsed:
    """Blocks with their heading path, and tables as cells; hidden and non-text parts are dropped, navigation is kept.

    Too large, too deep or too long input, and raw-text tags left open, are errors.
    """
    if len(content) > HTML_BYTES:
        raise Malformed("the file is too large")
    text, encoding = decode_text(content)
    low = text.lower()
    for tag in RAW:
        if (at := low.rfind(f"<{tag}")) >= 0 and low[at + len(tag) + 1 : at + len(tag) + 2] in (">", " ", "\n", "\t", "/") and low.find(f"</{tag}", at) < 0:
            raise Malformed(f"<{tag}> is left open")
    walker = _Walker()
    walker.feed(text)
    walker.close()
    walker._flush(None)
    while walker.tables:
        walker._end_table(walker.tables.pop())
    return Parsed(walker.out, walker.reasons + ([] if encoding == "utf-8" else [f"decoded as {encoding}"]))
