"""Reading units from text: a small grammar of currency, scale, area, time and energy words, not a list of spellings."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# The words of the grammar, by what they mean.
_WORDS = (
    ("CUR", r"us\s?\$|\$|usd|us dollars?|dollars?"),
    ("BP", r"basis (?:points?|pts?)|bps?"),
    ("PCT", r"%|per ?cent|percent|pct|prozent|porcentaje|pour ?cent"),
    ("RATIO", r"ratio|decimal|fraction"),
    ("PSF", r"psf"),
    ("SF", r"sq\.? ?ft|sqft|square f(?:ee|oo)t|ft2|sf"),
    ("SQM", r"sq\.? ?m|sqm|square met(?:re|er)s?|m2|qm"),
    ("ACRE", r"acres?|ac"),
    ("PCM", r"pcm|monthly"),
    ("PA", r"p\.?\s?a|annually|yearly"),
    ("MWH", r"mwh|megawatt[ -]?hours?"),
    ("KWH", r"kwh|kilowatt[ -]?hours?"),
    ("GJ", r"gj|gigajoules?"),
    ("QUARTER", r"calendar quarters?|quarters?|qtrs?|quartale?|trimestres?"),
    ("MONTH", r"m(?=\s+months?\b)|months?|mths?|mos?|monate?|mois|meses|mes"),
    ("YEAR", r"years?|yrs?|annum|y|jahre?|anos?|ans?"),
    ("K", r"thousands?|tsd|000s?|k|t(?=\s?usd\b)"),
    ("MIL", r"millions?|mio|mm|mn"),
    ("COUNT", r"counts?|ea|no|#|units?(?!\?)|in all"),
    ("PER", r"/|per"),
    ("FILL", r"in|as|of|a"),
)
# How units are commonly written in a field of their own, by what they mean.
UNIT_WORDS = {
    "usd": ("usd", "$", "us$", "us dollars", "dollars"),
    "usd_thousands": ("usd_thousands", "usd thousands", "usd 000", "usd k", "kusd", "tusd", "$k", "$000s", "$ thousand", "thousand dollars"),
    "usd_millions": ("usd_millions", "usd millions", "usd mm", "usd mn", "$mm", "us$ million", "million dollars", "mio. usd"),
    "ratio": ("ratio", "decimal", "fraction"),
    "percent": ("percent", "%", "per cent", "pct", "pct.", "prozent"),
    "bps": ("bps", "bp", "basis points", "basis pts"),
    "sf": ("sf", "sqft", "sq ft", "sq. ft.", "square feet", "ft²"),
    "sqm": ("sqm", "qm", "m2", "m²", "square metres", "square meters"),
    "acres": ("acres", "acre", "ac", "ac."),
    "thousand_sf": ("thousand_sf", "000 sf", "k sf"),
    "usd_per_sf": ("usd_per_sf", "usd/sf", "$/sf", "$ psf", "usd per sq ft"),
    "usd_per_sqm": ("usd_per_sqm", "usd/sqm"),
    "usd_per_sf_per_year": ("usd_per_sf_per_year", "usd/sf/year", "usd psf pa", "$/sf per annum", "$/sf/yr"),
    "usd_per_sf_per_month": ("usd_per_sf_per_month", "$/sf monthly"),
    "usd_per_sqm_per_year": ("usd_per_sqm_per_year", "usd per m2 per annum"),
    "years": ("years", "year", "yrs", "yr", "y", "annum", "jahre"),
    "quarters": ("quarters", "quarter", "quartale"),
    "months": ("months", "month", "monate"),
    "count": ("count", "units", "ea", "no.", "#"),
    "kwh": ("kwh",),
    "mwh": ("mwh",),
    "gj": ("gj",),
}
_TOKEN = re.compile("(?:" + "|".join(f"(?P<{name}>{words})" for name, words in _WORDS) + r")\.?(?![a-z0-9])")
_GAP = re.compile(r"\s*")


def _tokens(text: str) -> list[str] | None:
    found, at = [], _GAP.match(text).end()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        found.append(m.lastgroup)
        at = _GAP.match(text, m.end()).end()
    return found


@lru_cache(maxsize=100_000)
def read_unit(text: str | None) -> str | None:
    """The unit id a phrase names, or None if it names none (blank, fill-in words, units of other kinds)."""
    if not text:
        return None
    plain = re.sub(r"[_()\s]+", " ", unicodedata.normalize("NFKC", text).lower()).strip()
    plain = re.sub(r"\b(k|t)(?=usd\b|sf\b)", r"\1 ", plain)
    plain = re.sub(r"(?<=\$)(?=[a-z0-9])", " ", plain.replace("/", " / "))
    t = _tokens(plain)
    if not t:
        return None
    has = set(t) - {"FILL"}
    if "CUR" in has:
        month, year = has & {"PCM", "MONTH"}, has & {"PA", "YEAR"}
        if has & {"PSF", "SF"}:
            return "usd_per_sf_per_month" if month else "usd_per_sf_per_year" if year else "usd_per_sf"
        if "SQM" in has:
            return None if month else "usd_per_sqm_per_year" if year else "usd_per_sqm"
        if month or year or has - {"CUR", "K", "MIL"}:
            return None
        return "usd_thousands" if "K" in has else "usd_millions" if "MIL" in has else "usd"
    if "SF" in has:
        return "thousand_sf" if "K" in has else "sf" if has == {"SF"} else None
    single = {"SQM": "sqm", "ACRE": "acres", "PCT": "percent", "BP": "bps", "RATIO": "ratio", "YEAR": "years", "MONTH": "months", "QUARTER": "quarters", "KWH": "kwh", "MWH": "mwh", "GJ": "gj", "COUNT": "count", "K": "thousand_count"}
    if len(has) == 1:
        return single.get(has.pop())
    return "thousand_count" if has == {"K", "COUNT"} else None


#: A unit text names less than a quote if the quote names one of these: the same kind with a scale or a reference.
LESS_THAN = {
    "usd": {"usd_thousands", "usd_millions", "usd_per_sf", "usd_per_sqm", "usd_per_sf_per_year", "usd_per_sf_per_month", "usd_per_sqm_per_year"},
    "usd_per_sf": {"usd_per_sf_per_year", "usd_per_sf_per_month"},
    "usd_per_sqm": {"usd_per_sqm_per_year"},
    "count": {"thousand_count"},
    "sf": {"thousand_sf"},
}

_NUMBER = re.compile(r"(?<![\w.,])-?\d+(?:[.,\s  '’]\d{3}(?!\d))*(?:[.,]\d+)?|(?<=\$)\d[\d.,]*\d|(?<=\$)\d")
_BEFORE = re.compile(r"(?:us\s?\$|\$|usd|a ratio of)\s?$", re.IGNORECASE)
_AFTER = re.compile(r"\s(?:was reported|for\s|aus\b|en\s|pour\s)|\s?\|\s?|\s\((?!fraction\)|\$ in )|$")


def _values(token: str) -> set[float]:
    """What a written number can mean with a point or a comma as decimal sign."""
    plain = re.sub(r"[\s  '’]", "", token)
    found = set()
    for thousands, decimal in ((",", "."), (".", ",")):
        t = plain.replace(thousands, "").replace(decimal, ".")
        try:
            found.add(float(t))
        except ValueError:
            pass
    return found


def read_quoted_unit(quote: str | None, amount: float | None) -> str | None:
    """The unit written next to ``amount`` in a quote; None if the amount is not there or has no unit."""
    if not quote or amount is None:
        return None
    for m in _NUMBER.finditer(quote):
        if not any(abs(v - amount) <= 1e-9 * max(1.0, abs(amount)) for v in _values(m[0])):
            continue
        before = _BEFORE.search(quote, max(0, m.start() - 12), m.start())
        rest = quote[m.end() : m.end() + 60]
        unit = read_unit(((before[0] if before else "") + " " + rest[: _AFTER.search(rest).start()]).strip())
        if unit:
            return unit
    return None


def read_amount_unit(unit: str | None, quote: str | None, amount: float | None) -> tuple[str | None, str | None]:
    """(unit id, where it was read: 'unit' or 'quote'), or (None, None) where neither text tells it."""
    named = read_unit(unit)
    quoted = read_quoted_unit(quote, amount) if named is None or named in LESS_THAN else None
    if named is None:
        return (quoted, "quote") if quoted else (None, None)
    return (quoted, "quote") if quoted in LESS_THAN.get(named, ()) else (named, "unit")
