"""One normal form for dates, instants and periods written in any notation.

All notations are alternatives of one regular expression with named groups; a text is matched once, its components are
checked against the calendar, and instants are assembled by integer day arithmetic.  Only clock times in a named zone need
a time-zone table: those are resolved by Spark's own functions, inside the JVM.

The work is map-only: each text is read where it lies.  Repeated texts cost a dictionary look-up (bounded memory).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require

# Month names (en, de, es, fr, nl, pt), without accents, January first.
MONTHS = (
    "january jan januar janner enero ene janvier janv januari janeiro",
    "february feb februar febrero fevrier fevr februari fevereiro fev",
    "march mar marz mrz marzo mars maart mrt marco",
    "april apr abril abr avril avr",
    "may mai mayo mei maio",
    "june jun juni junio juin junho",
    "july jul juli julio juillet juil julho",
    "august aug agosto ago aout augustus",
    "september sep sept septiembre septembre setembro set",
    "october oct oktober okt octubre octobre outubro out",
    "november nov noviembre novembre novembro",
    "december dec dezember dez diciembre dic decembre desember dezembro",
)
MONTH_NUMBER = {name: i for i, names in enumerate(MONTHS, 1) for name in names.split()}

# Zone abbreviations that mean one offset, in minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "eet": 120, "eest": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "jst": 540, "kst": 540,
}

# Words for the quarters of a year.
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4}

_MONTH = "(?P<mon>" + "|".join(sorted(MONTH_NUMBER, key=len, reverse=True)) + r")\.?"
_CLOCK = r"(?P<H>\d{1,2})[:h](?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s?(?P<ap>[ap])\.?m\b\.?)?(?:\s?(?:uhr|h)\b)?"
_ZONE = r"\s?(?:(?P<off>[+-]\d{2}(?::?\d{2})?)(?:\s?\[[a-z_+\-0-9]+(?:/[a-z_+\-0-9]+)*\])?|\[?(?P<area>[a-z]+(?:/[a-z_+\-0-9]+)+)\]?|\(?(?P<abbr>" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + r")\)?)"
_TIME = rf"(?:(?:,?\s|t|\s(?:a|um|at|a las)\s){_CLOCK}(?:{_ZONE})?)?"
_WEEKDAY = r"(?:(?P<wd>mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s)?"
_YEAR = r"(?P<y>\d{4}|\d{2})"
_APOS = r"(?:\s?')?"

#: Notations of a day, with or without a clock time.
DAY_FORMATS = (
    rf"(?P<y>\d{{4}})-(?P<m>\d{{2}})-(?P<d>\d{{2}}){_TIME}",
    rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}}){_TIME}",
    rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t(?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})?(?:[.,](?P<f>\d{{1,9}}))?(?:{_ZONE})?",
    rf"(?P<n1>\d{{1,2}})(?P<sep>[/.\-])(?P<n2>\d{{1,2}})(?P=sep){_YEAR}{_TIME}",
    rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th)?\s(?:of\s|de\s)?{_MONTH},?\s(?:de\s)?(?P<y>\d{{4}}){_TIME}",
    rf"(?P<d>\d{{1,2}})-{_MONTH}-{_YEAR}{_TIME}",
    rf"{_WEEKDAY}{_MONTH}\s(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s(?P<y>\d{{4}}){_TIME}",
    r"(?P<num>\d{5}|\d{8}|\d{10}|\d{13}|\d{14}|\d{16}|\d{19})",
)
#: Notations of a month, quarter, year or fiscal year.
PERIOD_FORMATS = (
    r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})",
    r"(?P<m>\d{1,2})[-/.](?P<y>\d{4})",
    rf"{_MONTH}\s(?:de\s)?(?P<y>\d{{4}})",
    rf"{_MONTH}\s?[-']\s?{_YEAR}",
    rf"[qt](?P<q>\d)[\s/\-]?{_APOS}{_YEAR}",
    rf"(?P<q>\d)[qt]\s?{_APOS}{_YEAR}",
    r"(?P<y>\d{4})[\s\-/]?[qt](?P<q>\d)",
    r"(?P<q>\d)\.\s?quartal\s(?P<y>\d{4})",
    r"(?:the\s)?(?P<ord>first|second|third|fourth)\squarter(?:\sof|,)?\s(?P<y>\d{4})",
    r"(?:trimestre|quartal|quarter)\s(?P<q>\d)(?:\s(?:de|of))?[\s/](?P<y>\d{4})",
    r"(?P<fy>(?:fy|fiscal(?:\syear)?|gj|geschaftsjahr))\s?'?(?P<y>\d{4}|\d{2})",
    r"(?:cy\s?|(?:calendar\s|full\s)?year\s|jahr\s|kalenderjahr\s|ano\s|annee\s)?(?P<y>\d{4})a?",
)
_PERIOD_PREFIX = r"(?:(?:month|quarter|year|period)\s(?:ended|ending|to)\s)?"


def _number_groups(pattern: str, i: int) -> str:
    """Group names are made unique for alternative ``i``; a last, empty group tells which alternative matched."""
    return re.sub(r"\(\?P([<=])(\w+)", rf"(?P\1\2_{i}", pattern) + f"(?P<alt_{i}>)"


def _alternation(formats: tuple[str, ...], prefix: str = "") -> re.Pattern:
    return re.compile(prefix + "(?:" + "|".join(_number_groups(p, i) for i, p in enumerate(formats)) + ")", re.ASCII)


DAY_PATTERN = _alternation(DAY_FORMATS)
PERIOD_PATTERN = _alternation(DAY_FORMATS + PERIOD_FORMATS, _PERIOD_PREFIX)

_MONTH_DAYS = (0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
_WEEKDAYS = ("thu", "fri", "sat", "sun", "mon", "tue", "wed")  # of day 0, 1970-01-01, and those after


def days_from_civil(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01 in the Gregorian calendar; None where the calendar has no such day."""
    if not (1 <= m <= 12 and y >= 1):
        return None
    leap = m == 2 and (y % 4 == 0 and y % 100 != 0 or y % 400 == 0)
    if not 1 <= d <= _MONTH_DAYS[m] + leap:
        return None
    y -= m <= 2
    era, yoe = divmod(y, 400)
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def civil_from_days(z: int) -> tuple[int, int, int]:
    """The inverse of days_from_civil."""
    era, doe = divmod(z + 719468, 146097)
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    m = mp + 3 if mp < 10 else mp - 9
    return yoe + era * 400 + (m <= 2), m, doy - (153 * mp + 2) // 5 + 1


def _day_form(days: int) -> str:
    return "%04d-%02d-%02d" % civil_from_days(days)


def _instant_form(us: int) -> str:
    days, rest = divmod(us, 86_400_000_000)
    ms = rest // 1000
    return f"{_day_form(days)}T{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}Z"


def _fold(text: str) -> str:
    """Compatibility form, small letters, no accents, single blanks."""
    folded = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text.replace("’", "'")) if not unicodedata.combining(c))
    return " ".join(folded.lower().split())


def _year(text: str) -> int:
    return int(text) + (2000 if len(text) == 2 else 0)


def _readings(g: dict[str, str], order: str) -> set[tuple[int, int, int]]:
    """All (year, month, day) the matched components can mean under the date order of the locale ('' if unknown)."""
    y = _year(g["y"])
    if "n1" in g:
        a, b = int(g["n1"]), int(g["n2"])
        both = {"MD": (y, a, b), "DM": (y, b, a)}
        valid = {k: v for k, v in both.items() if days_from_civil(*v) is not None}
        return {valid[order]} if order in valid else set(valid.values())
    m = MONTH_NUMBER[g["mon"]] if "mon" in g else int(g["m"])
    r = (y, m, int(g["d"]))
    return {r} if days_from_civil(*r) is not None else set()


def _pure_number(text: str) -> tuple[set[int], int | None]:
    """Days, or microseconds, a pure number can mean: digits of a date, a spreadsheet's day count, or time since 1970."""
    n, size = int(text), len(text)
    if size == 5:
        return {n - 25569}, None  # day 25569 of the 1900 system is 1970-01-01
    if size in (8, 14):
        days = {d for d in (days_from_civil(int(text[:4]), int(text[4:6]), int(text[6:8])),) if d is not None and 1900 <= int(text[:4]) <= 2100}
        if size == 8:
            days |= {d for d in (days_from_civil(int(text[4:]), int(text[2:4]), int(text[:2])), days_from_civil(int(text[4:]), int(text[:2]), int(text[2:4]))) if d is not None and 1900 <= int(text[4:]) <= 2100}
            return days, None
        h, mi, s = int(text[8:10]), int(text[10:12]), int(text[12:])
        return (days, ((h * 60 + mi) * 60 + s) * 1_000_000) if h < 24 and mi < 60 and s < 60 else (set(), None)
    return set(), {10: n * 1_000_000, 13: n * 1000, 16: n, 19: n // 1000}[size]


def _clock(g: dict[str, str]) -> int | None:
    """Microseconds of the day; None if there is no such time."""
    h, mi, s = int(g["H"]), int(g["M"]), int(g.get("S") or 0)
    if "ap" in g:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"] == "p" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    return ((h * 60 + mi) * 60 + s) * 1_000_000 + int((g.get("f", "") + "000000")[:6])


def _slots(pattern: re.Pattern) -> dict[int, list[tuple[str, int]]]:
    """The named groups of each alternative."""
    slots: dict[int, list[tuple[str, int]]] = {}
    for name, index in pattern.groupindex.items():
        short, _, i = name.rpartition("_")
        slots.setdefault(int(i), []).append((short, index))
    return slots


_SLOTS = {p: _slots(p) for p in (DAY_PATTERN, PERIOD_PATTERN)}


def _components(m: re.Match) -> tuple[int, dict[str, str]]:
    """The alternative that matched, and its components, extracted once."""
    i = int(m.lastgroup.rpartition("_")[2])
    return i, {name: v for name, index in _SLOTS[m.re][i] if (v := m[index]) is not None}


def read_moment(text: str | None, order: str, local_zone: bool = True) -> tuple[str | None, int | None, str | None]:
    """(normal form, None, None), or (None, local microseconds, zone) for a clock time in a named zone ('' is the
    source's own), or three times None if the text has no reading or more than one.
    """
    none = (None, None, None)
    m = DAY_PATTERN.fullmatch(_fold(text)) if text else None
    if not m:
        return none
    _, g = _components(m)
    if "num" in g:
        days, us = _pure_number(g["num"])
        if not days:
            return none if us is None else (_instant_form(us), None, None)
        if len(days) > 1:
            return none
        return (_day_form(days.pop()), None, None) if us is None else (None, days.pop() * 86_400_000_000 + us, "")
    found = _readings(g, order)
    if len(found) != 1:
        return none
    day = days_from_civil(*found.pop())
    if "wd" in g and _WEEKDAYS[day % 7] != g["wd"]:
        return none
    if "H" not in g:
        return _day_form(day), None, None
    clock = _clock(g)
    if clock is None:
        return none
    local = day * 86_400_000_000 + clock
    if "off" in g:
        digits = g["off"][1:].replace(":", "")
        minutes = int(digits[:2]) * 60 + int(digits[2:] or 0)
        if minutes > 18 * 60 or int(digits[2:] or 0) > 59:
            return none
        return _instant_form(local - (minutes if g["off"][0] == "+" else -minutes) * 60_000_000), None, None
    if "abbr" in g:
        return _instant_form(local - ABBREVIATIONS[g["abbr"]] * 60_000_000), None, None
    return None, local, g.get("area", "")


def read_period(text: str | None, order: str) -> str | None:
    """YYYY-MM, YYYY-Qn, YYYY or FYYYYY; None if the text has no reading or more than one."""
    m = PERIOD_PATTERN.fullmatch(_fold(text)) if text else None
    if not m:
        return None
    i, g = _components(m)
    if "num" in g:
        days, us = _pure_number(g["num"])
        months = {civil_from_days(d)[:2] for d in days} or ({civil_from_days(us // 86_400_000_000)[:2]} if us is not None else set())
        return "%04d-%02d" % months.pop() if len(months) == 1 else None
    if i < len(DAY_FORMATS):
        months = {(y, mo) for y, mo, _ in _readings(g, order)}
        return "%04d-%02d" % months.pop() if len(months) == 1 else None
    y = _year(g["y"])
    if "fy" in g:
        return f"FY{y:04d}"
    if "q" in g or "ord" in g:
        q = ORDINALS[g["ord"]] if "ord" in g else int(g["q"])
        return f"{y:04d}-Q{q}" if 1 <= q <= 4 else None
    if "mon" in g or "m" in g:
        mo = MONTH_NUMBER[g["mon"]] if "mon" in g else int(g["m"])
        return f"{y:04d}-{mo:02d}" if 1 <= mo <= 12 else None
    return f"{y:04d}" if 1900 <= y <= 2099 else None


_READING = T.StructType([T.StructField("form", T.StringType()), T.StructField("local_us", T.LongType()), T.StructField("zone", T.StringType())])
_READING_ARROW = pa.struct([("form", pa.string()), ("local_us", pa.int64()), ("zone", pa.string())])


@lru_cache(maxsize=200_000)
def _read(field: str, text: str, order: str) -> tuple[str | None, int | None, str | None]:
    return (read_period(text, order), None, None) if field == "period" else read_moment(text, order)


@lru_cache(maxsize=1)
def _zone_names() -> dict[str, str]:
    """Time-zone names by their lower-case form."""
    import zoneinfo

    return {z.lower(): z for z in zoneinfo.available_timezones()}


@F.arrow_udf(_READING)
def _readings_of(fields: pa.Array, texts: pa.Array, orders: pa.Array, own_zones: pa.Array) -> pa.Array:
    known = _zone_names()
    forms, locals_, names = [], [], []
    for field, text, order, own in zip(fields.to_pylist(), texts.to_pylist(), orders.to_pylist(), own_zones.to_pylist(), strict=True):
        form, local, zone = _read(field, text, order) if text else (None, None, None)
        if local is not None:
            zone = known.get((zone or own or "").lower())
            local = local if zone else None
        forms.append(form)
        locals_.append(local)
        names.append(zone if local is not None else None)
    return pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(locals_, pa.int64()), pa.array(names, pa.string())], fields=list(_READING_ARROW))


def date_order(locale: Column) -> Column:
    """MD for locales that put the month first, DM for other known ones, '' without locale."""
    # Territories whose numeric dates put the month first.
    month_first = F.regexp_extract(locale, r"[-_]([A-Za-z]{2})$", 1).isin("US", "PH", "FM", "MH", "PW")
    return F.when(locale.isNull() | (F.trim(locale) == ""), "").when(month_first, "MD").otherwise("DM")


def with_utc(rows: DataFrame, local_us: str, zone: str, out: str) -> DataFrame:
    """Adds the UTC microseconds of a clock time in a zone; null if the clock showed that time twice or never there.

    The offsets a day before and a day after give the only two instants the clock time can mean; it is unambiguous if
    exactly one instant, looked up again in the zone, shows that time.  Each step is a column of its own: nothing is
    computed twice.
    """
    day = F.lit(86_400_000_000)
    shown = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), F.col(zone)))
    steps = rows.withColumn("_guess", F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col(local_us)), F.col(zone))))
    steps = steps.withColumn("_before", F.col("_guess") - day).withColumn("_after", F.col("_guess") + day)
    steps = steps.withColumn("_u1", F.col(local_us) - (shown(F.col("_before")) - F.col("_before"))).withColumn("_u2", F.col(local_us) - (shown(F.col("_after")) - F.col("_after")))
    steps = steps.withColumn("_ok1", shown(F.col("_u1")) == F.col(local_us)).withColumn("_ok2", shown(F.col("_u2")) == F.col(local_us))
    one = F.when(F.col("_ok1") & F.col("_ok2"), F.when(F.col("_u1") == F.col("_u2"), F.col("_u1"))).when(F.col("_ok1"), F.col("_u1")).when(F.col("_ok2"), F.col("_u2"))
    return steps.withColumn(out, one).drop("_guess", "_before", "_after", "_u1", "_u2", "_ok1", "_ok2")


def instant_text(us: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.mmmZ of UTC microseconds, by integer arithmetic (no session time zone involved)."""
    ms = ((us - F.pmod(us, F.lit(1000))) / 1000).cast("long")
    day = ((ms - F.pmod(ms, F.lit(86_400_000))) / 86_400_000).cast("int")
    rest = F.pmod(ms, F.lit(86_400_000)).cast("int")
    part = lambda c, n: F.lpad(c.cast("int").cast("string"), n, "0")
    return F.concat(
        F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"),
        part(F.floor(rest / 3_600_000), 2), F.lit(":"), part(F.floor(rest / 60_000) % 60, 2), F.lit(":"),
        part(F.floor(rest / 1000) % 60, 2), F.lit("."), part(rest % 1000, 3), F.lit("Z"),
    )


def normal_forms(texts: DataFrame, source_zone: str = "time_zone", locale: str = "locale") -> DataFrame:
    """Adds ``normal_form`` to rows with ``kind`` ('period' or 'moment') and ``text``; null where there is no one reading.

    Null, blank, vague and impossible texts have none.  A clock time without zone is in ``source_zone``; where that is
    null or unknown there is none either.
    """
    require(texts, "kind", "text", source_zone, locale)
    read = texts.withColumn("_r", _readings_of("kind", "text", date_order(F.col(locale)), source_zone))
    read = read.select(*texts.columns, F.col("_r.form").alias("_form"), F.col("_r.local_us").alias("_local"), F.col("_r.zone").alias("_zone"))
    found = with_utc(read, "_local", "_zone", "_utc")
    return found.withColumn("normal_form", F.coalesce("_form", instant_text(F.col("_utc")))).drop("_form", "_local", "_zone", "_utc")


def fact_moments(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """The normal forms of ``period_text`` and ``observed_at_text``: fact_id, field_name, normal_form, each case once.

    Facts whose source is unknown are read without locale and zone.
    """
    require(facts, "fact_id", "source_id", "period_text", "observed_at_text")
    where = sources.groupBy("source_id").agg(F.max("locale").alias("locale"), F.max("time_zone").alias("time_zone"))
    stacked = (
        facts.select("fact_id", "source_id", "period_text", "observed_at_text")
        .join(where, "source_id", "left")
        .select("fact_id", "locale", "time_zone", F.explode(F.array(
            F.struct(F.lit("period_text").alias("field_name"), F.lit("period").alias("kind"), F.col("period_text").alias("text")),
            F.struct(F.lit("observed_at_text").alias("field_name"), F.lit("moment").alias("kind"), F.col("observed_at_text").alias("text")),
        )).alias("_t"))
        .select("fact_id", "locale", "time_zone", "_t.*")
        .where("text IS NOT NULL AND trim(text) <> ''")
    )
    # Exploding drops the nulls; a filter would be pushed below the steps and repeat them all inside its condition.
    return normal_forms(stacked).select("fact_id", "field_name", F.explode(F.array_compact(F.array("normal_form"))).alias("normal_form")).distinct()
