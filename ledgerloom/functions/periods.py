"""Periods stated in running text, and their keys and ranges, as column expressions.

Eight notations are tried in a fixed order.  What one of them has matched is blanked out for the later ones, also where
its date does not exist (such a date is refused, it does not fall through to a looser notation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month names and their short forms, January first.
MONTHS = ("january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sept sep", "october oct", "november nov", "december dec")
MONTH_OF = {name: i for i, names in enumerate(MONTHS, 1) for name in names.split()}
_NAMES = "|".join(sorted(MONTH_OF, key=len, reverse=True))
_ANY = f"(?i:({_NAMES}))"

# The notations of periods.
#: Patterns in order; groups: year, month (number or name), day, quarter, as named by the second item.
NOTATIONS = (
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", "ymd"),
    (rf"\b{_ANY}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", "Mdy"),
    (rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{_ANY}\.?,?\s+(\d{{4}})\b", "dMy"),
    (r"\b(\d{4})-(\d{2})\b", "ym"),
    (r"\b(?i:Q)([1-4])[-\s]?(\d{4})\b", "qy"),
    (r"\b(\d{4})[-\s]?(?i:Q)([1-4])\b", "yq"),
    (r"\b(?i:FY)[-\s]?(\d{4})\b", "f"),
    (rf"\b{_ANY}\.?[\s,]+(\d{{4}})\b", "My"),
)


def _month_number(name: Column) -> Column:
    number = F.lit(None).cast("int")
    for i, names in reversed(list(enumerate(MONTHS, 1))):
        number = F.when(F.lower(name).isin(*names.split()), i).otherwise(number)
    return number


def _key(match: Column, pattern: str, groups: str) -> Column:
    """Key of one match, null if the calendar refuses it."""
    part = {g: F.regexp_extract(match, pattern, i) for i, g in enumerate(groups, 1)}
    if groups == "f":
        return F.concat(F.lit("FY"), part["f"])
    if "q" in groups:
        return F.concat(part["y"], F.lit("-Q"), part["q"])
    month = F.lpad(_month_number(part["M"]).cast("string"), 2, "0") if "M" in groups else part["m"]
    key = F.concat(part["y"], F.lit("-"), month)
    if "d" in groups:
        return F.when(F.try_to_date(F.concat(key, F.lit("-"), F.lpad(part["d"], 2, "0")), "yyyy-MM-dd").isNotNull(), key)
    return F.when(month.between("01", "12"), key)


def _keyed(pattern: str, groups: str):
    return lambda match: _key(match, pattern, groups)


def stated_periods(text: Column, bare_years: bool = True) -> Column:
    """Distinct keys of the periods a text states, by notation and then by place; an empty array for null.

    With ``bare_years`` a lone year from 1900 to 2099 counts, tried last.
    """
    found = []
    rest = F.trim(F.coalesce(text, F.lit("")))
    for pattern, groups in NOTATIONS:
        matches = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
        found.append(F.filter(F.transform(matches, _keyed(pattern, groups)), lambda k: k.isNotNull()))
        rest = F.regexp_replace(rest, pattern, "~")
    if bare_years:
        found.append(F.filter(F.regexp_extract_all(rest, F.lit(r"\b(\d{4})\b"), F.lit(0)), lambda y: y.between("1900", "2099")))
    return F.array_distinct(F.flatten(F.array(*found)))


def without_periods(text: Column) -> Column:
    """The text with its stated periods (whatever their calendar says) and lone years blanked out; null stays null."""
    rest = text
    for pattern, _ in NOTATIONS:
        rest = F.regexp_replace(rest, pattern, " ~ ")
    return F.regexp_replace(rest, r"\b(19|20)\d{2}\b(?![.,%]\d)", " ~ ")


def ledger_period(argument: Column, folded: Column, parsed: Column) -> Column:
    """The period key a caller's argument means: 'undated' as it is, 'undated:' with its rest folded, else the parsed key.

    ``folded``: entity_fold of the argument.  Null and blank mean undated.
    """
    prefix = F.lit("undated:")
    return F.when(F.coalesce(F.trim(argument), F.lit("")).isin("", "undated"), "undated").when(F.startswith(argument, prefix), F.concat(prefix, F.trim(F.substring(folded, 9, 2**31 - 1)))).otherwise(parsed)


def unparseable_key(folded: Column) -> Column:
    """Key of a text that states no period: up to 64 characters of it, longer ones with a digest."""
    digest = F.substring(F.sha2(folded, 256), 1, 16)
    return F.concat(F.lit("undated:"), F.when(F.length(folded) <= 64, folded).otherwise(F.concat(F.substring(folded, 1, 64), F.lit("#"), digest)))


def with_period_key(rows: DataFrame, text: str, folded: str, out: str) -> DataFrame:
    """Adds the period key of a text: its first stated one, a whole text that is a year, 'undated' if blank, else an
    unparseable key.  ``folded`` names the column with entity_fold of the text.

    Each notation's match and the rest it leaves are columns of their own, so that no pattern runs twice on a row.
    """
    steps = rows.withColumn("_rest0", F.trim(F.coalesce(F.col(text), F.lit(""))))
    for i, (pattern, groups) in enumerate(NOTATIONS):
        rest = F.col(f"_rest{i}")
        keys = F.filter(F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), _keyed(pattern, groups)), lambda k: k.isNotNull())
        steps = steps.withColumn(f"_key{i}", F.try_element_at(keys, F.lit(1))).withColumn(f"_rest{i + 1}", F.regexp_replace(rest, pattern, "~"))
    plain = F.col("_rest0")
    key = F.when(plain == "", "undated").otherwise(F.coalesce(*[F.col(f"_key{i}") for i in range(len(NOTATIONS))], F.when(plain.rlike(r"^(19|20)\d{2}$"), plain), unparseable_key(F.col(folded))))
    return steps.withColumn(out, key).drop(*[f"_key{i}" for i in range(len(NOTATIONS))], *[f"_rest{i}" for i in range(len(NOTATIONS) + 1)])


def period_granularity(key: Column) -> Column:
    """month, quarter, year, fiscal-year, unstated or unparseable."""
    return (
        F.when(key == "undated", "unstated").when(key.rlike(r"^FY\d{4}$"), "fiscal-year").when(key.rlike(r"^\d{4}-Q[1-4]$"), "quarter")
        .when(key.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), "month").when(key.rlike(r"^\d{4}$"), "year").when(key.isNotNull(), "unparseable")
    )


def period_start(key: Column) -> Column:
    """First day of a period with a range (month, quarter, year); null for others."""
    kind, year = period_granularity(key), F.substring(key, 1, 4)
    month = F.when(kind == "month", F.substring(key, 6, 2)).when(kind == "quarter", F.lpad((F.substring(key, 7, 1).cast("int") * 3 - 2).cast("string"), 2, "0")).when(kind == "year", "01")
    return F.try_to_date(F.concat(year, F.lit("-"), month, F.lit("-01")), "yyyy-MM-dd")


def period_end(key: Column) -> Column:
    """Last day of a period with a range; null for others."""
    kind = period_granularity(key)
    months = F.when(kind == "month", 0).when(kind == "quarter", 2).when(kind == "year", 11)
    return F.last_day(F.add_months(period_start(key), months))


def periods_overlap(a: Column, b: Column) -> Column:
    """Whether two keys have ranges that share a day; fiscal, undated and unparseable periods have none."""
    return F.coalesce((period_start(a) <= period_end(b)) & (period_start(b) <= period_end(a)), F.lit(False))


def real_date(text: Column) -> Column:
    """The date of a strict YYYY-MM-DD text, null if the calendar has no such day."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
