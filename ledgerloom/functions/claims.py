"""Comparing claims with what they quote: numbers in words and digits, content words, negation, alignment, quotes.

Plain functions on texts, and Arrow functions around them for whole columns.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English cardinals, and words that carry no content.
ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
STOPWORDS = frozenset("the and for that with this from was were have shall each are its into upon such any all may can".split())

SAFE = 2**53 - 1
LEAST_QUOTE_TOKENS, LEAST_SHARED, SHARED_SHARE, FUZZY = 3, 2, 0.2, 0.85

_DIGITS = re.compile(r"\$?\(\$?\d[\d,]*(?:\.\d+)?%?\)|\$?\d[\d,]*(?:\.\d+)?%?", re.ASCII)
_LETTERS = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[\W_]+")
_SPACES = re.compile("[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")
# Words that deny.
_NEGATION = re.compile(r"\b(?:not|no|never|none|neither|nor|cannot)\b|\bwithout\b(?! +limitation\b)|\b\w*n't\b", re.ASCII)
_QUOTES = str.maketrans("‘’‚‛“”„‟–—− ", "''''\"\"\"\"--- ")
_UNSEGMENTED = ("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HIRAGANA", "KATAKANA")


def quote_fold(text: str) -> str:
    """Straight quotes, plain hyphens, single blanks, trimmed."""
    return _SPACES.sub(" ", text.translate(_QUOTES)).strip(" ")


def _neutral(text: str, break_as: str, invisible_as: str) -> str:
    """Odd blanks and line separators as ``break_as``; control, format and combining characters as ``invisible_as``."""
    out = []
    for c in text:
        kind = unicodedata.category(c)
        if kind in ("Zl", "Zp") or (kind == "Zs" and c != " "):
            out.append(break_as)
        elif (kind == "Cc" and c not in "\t\n\r") or kind in ("Cf", "Mn", "Me"):
            out.append(invisible_as)
        else:
            out.append(c)
    return "".join(out)


def aligned_form(text: str) -> str:
    """The form in which words are compared."""
    if text.isascii() and text.isprintable():
        return quote_fold(text).lower()
    return quote_fold(unicodedata.normalize("NFKC", _neutral(text, " ", ""))).lower()


def spelled_numbers(text: str) -> list[tuple[int, int, float]]:
    """(start, end, value) of numbers in words.  A lone 'one' and scales without a number before them are none."""
    words = [(m.start(), m.end(), m[0].lower()) for m in _LETTERS.finditer(text)]
    found, i = [], 0
    while i < len(words):
        begin, total, group, anchored, n = i, 0, 0, False, 0
        while i < len(words) and (w := words[i][2]) in ONES or i < len(words) and words[i][2] in TENS or i < len(words) and words[i][2] in SCALES:
            w = words[i][2]
            if w in SCALES:
                if w == "hundred":
                    group = (group or 1) * 100
                else:
                    total, group = total + (group or 1) * SCALES[w], 0
            else:
                group, anchored = group + (ONES[w] if w in ONES else TENS[w]), True
            i, n = i + 1, n + 1
        if not n:
            i += 1
            continue
        value, end, decimal = float(total + group), words[i - 1][1], ""
        if i < len(words) and words[i][2] == "point":
            j = i + 1
            while j < len(words) and ONES.get(words[j][2], 10) <= 9:
                decimal += str(ONES[words[j][2]])
                j += 1
            if decimal:
                value, end, i = float(f"{total + group}.{decimal}"), words[j - 1][1], j
        if anchored and abs(value) <= SAFE and not (n == 1 and words[begin][2] == "one" and not decimal):
            found.append((words[begin][0], end, value))
    return found


def _digit_value(token: str) -> float:
    size = float(re.sub(r"[$,%()]", "", token))
    return -size if "(" in token else size


def numbers_in(text: str) -> list[tuple[int, int, float]]:
    """(start, end, value) of all numbers of a text, by place; positions are in its NFKC form."""
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text)
    digits = [(m.start(), m.end(), v) for m in _DIGITS.finditer(plain) if abs(v := _digit_value(m[0])) <= SAFE]
    return sorted(digits + spelled_numbers(plain))


def has_unreadable_number(text: str) -> bool:
    """Whether a text holds a number that is not faithfully readable: other digits than 0-9, or too large."""
    plain = unicodedata.normalize("NFKC", text)
    return any(c.isdecimal() and not c.isascii() for c in plain) or any(abs(_digit_value(m[0])) > SAFE for m in _DIGITS.finditer(plain))


def number_token(value: float) -> str:
    return "#" + (str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value))


@lru_cache(maxsize=50_000)
def content_tokens(text: str) -> frozenset[str]:
    """Content words (no stopwords, no ASCII words below three letters, no digits) and '#number' tokens."""
    plain = aligned_form(text)
    words = {w for w in _SPLIT.split(plain) if w and not w.isdecimal() and not (w.isascii() and (len(w) < 3 or w in STOPWORDS))}
    return frozenset(words | {number_token(v) for _, _, v in numbers_in(plain)})


def is_negated(text: str) -> bool:
    """Whether a text denies something, whether hidden characters are dropped or taken for blanks."""
    for put in ("", " "):
        plain = quote_fold(unicodedata.normalize("NFKC", _neutral(text, put, put))).lower()
        if _NEGATION.search("".join(c if c.isalnum() or " " <= c <= "~" else put for c in plain)):
            return True
    return False


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def script_fault(text: str) -> str | None:
    """'script-unsupported' for scripts without word breaks, 'mixed-script' for a word of Latin and other letters."""
    if text.isascii():
        return None
    if any(unicodedata.name(c, "").startswith(_UNSEGMENTED) for c in text if not c.isascii()):
        return "script-unsupported"
    for word in _SPLIT.split(quote_fold(_neutral(text, " ", "")).lower()):
        kinds = {_script(c) for c in word} - {"", "MODIFIER", "FEMININE", "MASCULINE", "MICRO"}
        if "LATIN" in kinds and len(kinds) > 1:
            return "mixed-script"
    return None


def quote_alignment(statement: str, quotes: list[str], corroborated: frozenset[float] = frozenset()) -> str:
    """Whether quotes carry a statement: aligned, or the first thing that is wrong."""
    for check in [script_fault(t) for t in (statement, *quotes)]:
        if check == "script-unsupported":
            return "quote-script-unsupported"
    if any(script_fault(t) == "mixed-script" for t in (statement, *quotes)):
        return "quote-mixed-script"
    known = {number_token(v) for v in corroborated}
    for q in quotes:
        tokens = content_tokens(q)
        if len(tokens) < LEAST_QUOTE_TOKENS and not tokens & known:
            return "quote-not-substantive"
    own = content_tokens(statement)
    shared = own & frozenset().union(*map(content_tokens, quotes))
    words = sum(not t.startswith("#") for t in own)
    if not shared & known and sum(not t.startswith("#") for t in shared) < max(LEAST_SHARED, math.ceil(words * SHARED_SHARE)):
        return "quote-unrelated-to-statement"
    return "aligned" if is_negated(statement) == any(map(is_negated, quotes)) else "quote-contradicts-statement"


def substring_distance(text: str, pattern: str) -> int:
    """Least edits that turn some part of a text into the pattern (bit-parallel: one step per character of the text)."""
    if not pattern:
        return 0
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, len(pattern)
    best = score
    for c in text:
        equal = where.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rises, falls = down | (full & ~(horizontal | up)), up & horizontal
        score += 1 if rises & top else -1 if falls & top else 0
        best = min(best, score)
        rises, falls = rises << 1 & full, falls << 1 & full
        up, down = falls | (full & ~(vertical | rises)), rises & vertical
    return best


def locate_quote(quote: str, text: str) -> tuple[str, float]:
    """(exact, fuzzy or none; similarity) of a quote in a text.  The distance is computed only where exact search fails."""
    q, t = quote_fold(quote), quote_fold(text)
    if not q:
        return "none", 0.0
    if q in t:
        return "exact", 1.0
    similarity = max(0.0, 1 - substring_distance(t, q) / len(q))
    return ("fuzzy" if similarity >= FUZZY else "none"), similarity


def atom_coverage(statement: str, atoms: list[str]) -> tuple[bool, list[str], list[str]]:
    """(covered, tokens no atom has, tokens the statement has not)."""
    own, parts = content_tokens(statement), frozenset().union(*map(content_tokens, atoms))
    return bool(atoms) and own == parts, sorted(own - parts), sorted(parts - own)


_LOCATED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("similarity", T.DoubleType())])


@F.arrow_udf(_LOCATED)
def locate_quote_column(quotes: pa.Array, texts: pa.Array) -> pa.Array:
    got = [locate_quote(q, t) if q is not None and t is not None else ("none", 0.0) for q, t in zip(quotes.to_pylist(), texts.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["kind", "similarity"])


@F.arrow_udf(T.StringType())
def quote_alignment_column(statements: pa.Array, quotes: pa.Array) -> pa.Array:
    return pa.array([None if s is None else quote_alignment(s, [x for x in (q or []) if x is not None]) for s, q in zip(statements.to_pylist(), quotes.to_pylist(), strict=True)], pa.string())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def numbers_column(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else [v for _, _, v in numbers_in(t)] for t in texts.to_pylist()], pa.list_(pa.float64()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def content_tokens_column(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else sorted(content_tokens(t)) for t in texts.to_pylist()], pa.list_(pa.string()))


# Words beside a number that tell its magnitude and its kind.
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mm": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9}
PERCENT_WORDS, AREA_WORDS, YEAR_WORDS, MONTH_WORDS = frozenset(("percent", "pct")), frozenset(("sf", "rsf")), frozenset(("year", "years", "yr")), frozenset(("month", "months"))
_AREA_PHRASES = (("sq", "ft"), ("square", "feet"), ("square", "foot"))


def number_kind(written: str, before: str | None, after: list[str]) -> tuple[str, float]:
    """(percentage, currency, area, duration or unknown; factor to the kind's plain unit) of a number, by its two next words."""
    pair = tuple(after[:2])
    if written.endswith("%") or PERCENT_WORDS & set(after):
        return "percentage", 0.01
    if after[:1] == ["bps"] or pair == ("basis", "points"):
        return "percentage", 0.0001
    factor = next((MAGNITUDES[w] for w in after if w in MAGNITUDES), 1.0)
    if "$" in written or before == "usd":
        return "currency", factor
    if AREA_WORDS & set(after) or pair in _AREA_PHRASES:
        return "area", factor
    if YEAR_WORDS & set(after):
        return "duration", 1.0
    if MONTH_WORDS & set(after):
        return "duration", 1 / 12
    return "unknown", factor


def assertions_in(masked: str) -> list[tuple[float, str, float]]:
    """(value, kind, value in the kind's plain unit) of the numbers of a text whose periods are blanked out."""
    plain = masked if masked.isascii() else unicodedata.normalize("NFKC", masked)
    words = [(m.start(), m.end(), m[0].lower()) for m in _LETTERS.finditer(plain)]
    found = []
    for a, b, value in numbers_in(plain):
        before = next((w for s, e, w in reversed(words) if e <= a), None)
        after = [w for s, _, w in words if s >= b][:2]
        kind, factor = number_kind(plain[a:b], before, after)
        found.append((value, kind, value * factor))
    return found


_ASSERTED = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("kind", T.StringType()), T.StructField("plain", T.DoubleType())]))


@F.arrow_udf(_ASSERTED)
def assertions_column(masked: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("value", pa.float64()), ("kind", pa.string()), ("plain", pa.float64())]))
    return pa.array([None if t is None else [dict(zip(("value", "kind", "plain"), x)) for x in assertions_in(t)] for t in masked.to_pylist()], kind)


@F.arrow_udf(T.BooleanType())
def unreadable_number_column(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else has_unreadable_number(t) for t in texts.to_pylist()], pa.bool_())
