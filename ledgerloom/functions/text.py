"""Text normalisation and matching as column expressions.

White space is what ECMAScript calls so (see unicode.JS_SPACE); null in, null out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.unicode import JS_SPACE, collapse_space, nfc, nfkc


def entity_fold(c: Column) -> Column:
    """NFKC, single blanks, trimmed, small letters: the form under which entity names are compared."""
    return F.lower(collapse_space(nfkc(c)))


def group_key(entity: Column, metric: Column, period: Column) -> Column:
    """Key of a ledger cell: the folded entity, the metric and the period; null if one of them is."""
    return F.concat(entity_fold(entity), F.lit("::"), metric, F.lit("::"), period)


def near_match_fold(c: Column) -> Column:
    """entity_fold with & as and, without points, commas and hyphens, and without one trailing corporate suffix."""
    t = F.regexp_replace(F.replace(entity_fold(c), F.lit("&"), F.lit("and")), r"[.,\-]", " ")
    return F.trim(F.regexp_replace(collapse_space(t), r" (llc|inc|ltd|l ?p|corp)$", ""))


def quote_fold(c: Column) -> Column:
    """Straight quotes, plain hyphens, single blanks."""
    return collapse_space(F.translate(c, "‘’‚‛“”„‟–—−", "''''\"\"\"\"---"))


def display_safe(c: Column) -> Column:
    """Without control characters (but tab and line ends) and format characters; NFC."""
    return nfc(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|\p{Cf}", ""))


def sanitize_delimiters(c: Column) -> Column:
    """Neutralises tags that would open or close an evidence block."""
    return F.regexp_replace(c, r"(?i)<(/?)(evidence)", "&lt;$1$2")


def prompt_label(c: Column) -> Column:
    """One line of text, fit as a label."""
    return F.trim(F.regexp_replace(sanitize_delimiters(c), r"[\r\n]+", " "))


def alias_key(c: Column) -> Column:
    """The form under which labels and aliases are compared: trimmed, small letters."""
    return F.lower(F.regexp_replace(c, f"^{JS_SPACE}+|{JS_SPACE}+$", ""))


def measure_slug(header: Column) -> Column:
    """Slug of a column header: no parentheses, $ or %; NFKC; runs of other characters as one underscore; null if unfit."""
    bare = F.regexp_replace(F.regexp_replace(header, r"\([^)]*\)", ""), r"[$%]", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(nfkc(bare)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(slug.rlike(r"^[a-z][a-z0-9_]{0,63}$"), slug)


def header_unit(header: Column) -> Column:
    """'percent' or 'ratio' if a header ends with such a mark in parentheses, else null."""
    mark = F.lower(F.regexp_extract(header, r"(?i)\s*\((%|percent|ratio)\)\s*$", 1))
    return F.when(mark == "ratio", "ratio").when(mark != "", "percent")


def header_base(header: Column) -> Column:
    """The header without its unit mark."""
    bare = F.regexp_replace(header, r"(?i)\s*\((%|percent|ratio)\)\s*$", "")
    return F.when(header_unit(header).isNull(), header).otherwise(F.trim(bare))


def attachment_name(c: Column) -> Column:
    """The last path segment with unsafe characters as underscores, its last 200 characters; null if nothing is left."""
    base = F.regexp_replace(c, r"^.*[/\\]", "")
    safe = F.trim(F.regexp_replace(base, r"[\x00-\x1f\x7f<>:\"|?*]", "_"))
    return F.when(safe.rlike(r"[^._ ]"), F.right(safe, F.lit(200)))


def approx_tokens(c: Column) -> Column:
    """Characters of CJK scripts, plus a quarter of the others, rounded up."""
    cjk = F.regexp_count(c, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))
    return F.ceil(cjk + (F.length(c) - cjk) / 4).cast("int")


# Patterns of instructions hidden in evidence.  \w and word ends are ASCII, as in ECMAScript.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
INJECTION_PATTERNS = (
    rf"(?i){_B}(?:ignore|disregard){_E}(?:\s+\w+){{0,3}}?\s+(?:instructions?|the\s+above){_E}",
    rf"(?i){_B}you\s+(?:must|are\s+to|will)\s+now{_E}",
    rf"(?i){_B}you\s+are\s+now\s+in\s+[\w-]+(?:[- ][\w-]+)*\s+mode{_E}",
    rf"(?i){_B}system\s+prompt{_E}",
    rf"(?i){_B}(?:export|send|email)\s+(?:the\s+)?(?:full\s+|complete\s+|entire\s+|underlying\s+)*(?:deal[- ]room|contents|documents?|database|system\s+prompt){_E}",
)


def looks_injected(c: Column) -> Column:
    """Whether a text holds instructions to the reader of the evidence; false for null."""
    hit = F.lit(False)
    for p in INJECTION_PATTERNS:
        hit = hit | F.coalesce(c.rlike(p), F.lit(False))
    return hit


def has_token(haystack: Column, needle: Column) -> Column:
    """Whether a phrase occurs in a text with no letter or digit beside it; false for an empty phrase."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    # contains() first: it is cheap, and rules nearly every pair out before a pattern is compiled.
    return (needle != "") & haystack.contains(needle) & F.regexp_like(haystack, quoted)


def has_ascii_token(haystack: Column, needle: Column) -> Column:
    """The same with only a-z and 0-9 counting as neighbours."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    return (needle != "") & haystack.contains(needle) & F.regexp_like(haystack, quoted)


def digit_numbers(c: Column) -> Column:
    """The numbers a text writes in digits, in order: $ and % dropped, parentheses negative, unsafe magnitudes left out."""
    tokens = F.regexp_extract_all(c, F.lit(r"(\$?\(\$?\d[\d,]*(?:\.\d+)?%?\)|\$?\d[\d,]*(?:\.\d+)?%?)"), F.lit(1))
    value = lambda t: F.when(t.contains("("), -1.0).otherwise(1.0) * F.regexp_replace(t, r"[$,%()]", "").cast("double")
    return F.filter(F.transform(tokens, value), lambda v: F.abs(v) <= 9007199254740991.0)


def column_number(letters: Column) -> Column:
    """Number of a spreadsheet column from its letters (A is 1)."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def cell_parts(address: Column) -> Column:
    """Struct (column, row) of an A1 address; null fields if it is none."""
    good = address.rlike(r"^[A-Z]+\d+$")
    return F.struct(
        F.when(good, column_number(F.regexp_extract(address, r"^([A-Z]+)", 1))).alias("column"),
        F.when(good, F.regexp_extract(address, r"(\d+)$", 1).cast("int")).alias("row"),
    )


def locator_text(locator: Column) -> Column:
    """A locator in words."""
    path = F.when(F.size(locator["heading_path"]) > 0, F.concat(F.lit(" ("), F.array_join(locator["heading_path"], " > "), F.lit(")"))).otherwise("")
    return (
        F.when(locator["kind"] == "pdf-page", F.concat(F.lit("page "), locator["page"]))
        .when(locator["kind"] == "docx-paragraph", F.concat(F.lit("paragraph "), locator["paragraph_index"], path))
        .when(locator["kind"] == "text-block", F.concat(F.lit("block "), locator["block_index"], path))
        .when(locator["kind"] == "pptx-slide", F.concat(F.lit("slide "), locator["slide"]))
        .when(locator["kind"] == "xlsx-region", F.concat(locator["sheet_name"], F.lit("!"), locator["range"]))
        .when(locator["kind"] == "xlsx-cell", F.concat(locator["sheet_name"], F.lit("!"), locator["cell"]))
    )
