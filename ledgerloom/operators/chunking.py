"""Cutting documents into chunks for retrieval."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require
from ledgerloom.sources.texts import parse_text

TARGET, MOST, OVERLAP, ROWS = 700, 805, 84, 4  # tokens to aim at, tokens at most, tokens repeated, sheet rows per chunk


def _is_cjk(c: str) -> bool:
    return not c.isascii() and unicodedata.name(c, "").startswith(("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HIRAGANA", "KATAKANA", "HANGUL"))


def approx_tokens(text: str) -> int:
    """Characters of CJK scripts, plus a quarter of the others, rounded up."""
    cjk = 0 if text.isascii() else sum(map(_is_cjk, text))
    return math.ceil(cjk + (len(text) - cjk) / 4)


def _weighted_length(text: str, tokens: float) -> int:
    """How many characters from the start weigh at least so many tokens."""
    if text.isascii():
        return min(len(text), math.ceil(tokens * 4))
    weight = 0.0
    for i, c in enumerate(text):
        weight += 1 if _is_cjk(c) else 0.25
        if weight >= tokens:
            return i + 1
    return len(text)


def split_oversize(text: str, tokens: int = TARGET) -> list[str]:
    """Pieces of about ``tokens``, cut at the last blank before the limit, or at the limit where there is none."""
    pieces, rest = [], text
    while approx_tokens(rest) > tokens:
        end = _weighted_length(rest, tokens)
        cut = rest.rfind(" ", 0, end + 1)
        cut = cut if cut > 0 else end
        pieces.append(rest[:cut])
        rest = rest[cut:].lstrip()
    return [*pieces, rest] if rest else pieces


def _tail(text: str, tokens: int = OVERLAP) -> str:
    """The last so many tokens, from the next word on."""
    if approx_tokens(text) <= tokens:
        return text
    part = text[len(text) - _weighted_length(text[::-1], tokens) :]
    _, blank, after = part.partition(" ")
    return after if blank else part


def chunk_prose(elements: list[tuple[str, tuple[str, ...]]]) -> list[dict]:
    """Chunks of (text, heading path) elements: text, n_tokens, first, n_elements.

    A change of heading path ends a run.  Elements are joined by blank lines until the next would pass the limit; every
    chunk but the first of a run begins with the end of the one before.  Elements above the limit are cut first.
    """
    chunks: list[dict] = []
    path: object = None
    body, first, count, prefix = "", 0, 0, ""

    def flush() -> None:
        nonlocal body, count, prefix
        if not count:
            return
        text = f"{prefix} {body}" if prefix else body
        chunks.append({"text": text, "n_tokens": approx_tokens(text), "first": first, "n_elements": count})
        prefix, body, count = _tail(body), "", 0

    for i, (text, heading) in enumerate(elements):
        if heading != path:
            flush()
            path, prefix = heading, ""
        for piece in split_oversize(text) if approx_tokens(text) > MOST else [text]:
            joined = f"{body}\n\n{piece}" if body else piece
            if count and approx_tokens(joined) > MOST:
                flush()
                joined = piece
            if not count:
                first = i
            body, count = joined, count + 1
    flush()
    return chunks


# How characters that would break a row of a Markdown table are written.
_ESCAPES = str.maketrans({"\\": "\\\\", "|": "\\|", "\n": "\\n", "\r": "\\r", "\x0b": "\\v", "\x0c": "\\f", "\x85": "\\u0085", " ": "\\u2028", " ": "\\u2029"})


def markdown_row(cells: list[str]) -> str:
    """A row of a Markdown table; a row that would read as the separator is neutralised."""
    safe = [c.translate(_ESCAPES) for c in cells]
    if all(re.fullmatch(r"\s*:?-+:?\s*", c) for c in safe):
        safe = [c.replace("-", "\\-", 1) for c in safe]
    return f"| {' | '.join(safe)} |"


def header_row(rows: dict[int, list[str]]) -> int:
    """The first of the first ten rows with two or more, not all equal, filled cells and a row after it; else the first."""
    order = sorted(rows)
    for r in order[:10]:
        filled = [t for t in rows[r] if t.strip()]
        if len(filled) >= 2 and len(set(filled)) >= 2 and r < order[-1]:
            return r
    return order[0] if order else 1


def chunk_sheet(cells: list[tuple[int, int, str]]) -> list[dict]:
    """Chunks of a sheet's (row, column, text) cells: text, n_tokens, first_row, last_row.

    Rows above the header make one chunk; then windows of four rows (fewer if they are long), each under the header.
    """
    if not cells:
        return []
    table: dict[int, dict[int, str]] = {}
    for r, c, t in cells:
        table.setdefault(r, {})[c] = t
    top = header_row({r: list(v.values()) for r, v in table.items()})
    columns = sorted({c for r, v in table.items() if r >= top for c in v})
    line = lambda r: markdown_row([table[r].get(c, "") for c in columns])
    make = lambda text, a, b: {"text": text, "n_tokens": approx_tokens(text), "first_row": a, "last_row": b}
    out = []
    if above := sorted(r for r in table if r < top):
        out.append(make("\n".join(map(line, above)), above[0], above[-1]))
    head = line(top) + "\n| " + " | ".join(["---"] * len(columns)) + " |"
    window: list[int] = []
    for r in sorted(r for r in table if r > top):
        if window and (len(window) >= ROWS or approx_tokens("\n".join([head, *map(line, window), line(r)])) > MOST):
            out.append(make("\n".join([head, *map(line, window)]), window[0], window[-1]))
            window = []
        window.append(r)
    if window:
        out.append(make("\n".join([head, *map(line, window)]), window[0], window[-1]))
    return out


_CHUNK = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ordinal", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("first_block", T.IntegerType())])


def _chunk_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks = [(e.text, e.heading_path) for e in parse_text((text or "").encode()).elements]
            rows += [{"doc_id": doc, "ordinal": i, "text": c["text"], "n_tokens": c["n_tokens"], "first_block": c["first"]} for i, c in enumerate(chunk_prose(blocks))]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("ordinal", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int32()), ("first_block", pa.int32())]))


def chunk_documents(documents: DataFrame) -> DataFrame:
    """Chunks of plain texts: doc_id, ordinal, text, n_tokens, first_block.  Map-only; null and blank texts have none."""
    require(documents, "doc_id", "text")
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_chunk_texts, _CHUNK)


def chunk_id(tenant: Column, content_hash: Column, ordinal: Column, version: str, locator: Column) -> Column:
    """Identity of a chunk: it follows from its content and place alone."""
    return F.sha2(F.concat_ws(":", tenant, content_hash, ordinal.cast("string"), F.lit(version), locator), 256)


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces; numbers that are no finite numbers are refused; whole doubles are integers."""

    def plain(v: object) -> object:
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a finite number")
            return int(v) if v == int(v) and abs(v) < 1e21 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
