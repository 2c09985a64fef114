"""Pieces of SQL that several oracle texts share."""

from __future__ import annotations

from ledgerloom.functions.periods import MONTHS, NOTATIONS
from ledgerloom.functions.unit_text import UNIT_WORDS


def fold(column: str) -> str:
    """entity_fold, for texts whose compatibility characters are at most odd blanks."""
    return f"lower(trim(regexp_replace(nfc_normalize({column}), '[\\s\\x{{00a0}}\\x{{3000}}]+', ' ', 'g')))"


def _month(name: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({name}) IN ({', '.join(repr(n) for n in names.split())}) THEN '{i:02d}'" for i, names in enumerate(MONTHS, 1)) + " END"


def _key(match: str, pattern: str, groups: str) -> str:
    part = {g: f"regexp_extract({match}, '{pattern}', {i})" for i, g in enumerate(groups, 1)}
    if groups == "f":
        return f"'FY' || {part['f']}"
    if "q" in groups:
        return f"{part['y']} || '-Q' || {part['q']}"
    key = f"{part['y']} || '-' || {_month(part['M']) if 'M' in groups else part['m']}"
    if "d" in groups:
        return f"CASE WHEN try_cast({key} || '-' || lpad({part['d']}, 2, '0') AS DATE) IS NOT NULL THEN {key} END"
    month = _month(part["M"]) if "M" in groups else part["m"]
    return f"CASE WHEN {month} BETWEEN '01' AND '12' THEN {key} END"


def stated(column: str, bare_years: bool) -> tuple[str, str]:
    """(column definitions that must precede, expression) for the distinct periods a text states."""
    steps, found, rest = [f"trim(coalesce({column}, '')) AS _r0"], [], "_r0"
    for i, (pattern, groups) in enumerate(NOTATIONS):
        found.append(f"list_filter(list_transform(regexp_extract_all({rest}, '{pattern}'), lambda m: {_key('m', pattern, groups)}), lambda k: k IS NOT NULL)")
        steps.append(f"regexp_replace({rest}, '{pattern}', '~', 'g') AS _r{i + 1}")
        rest = f"_r{i + 1}"
    if bare_years:
        found.append(rf"list_filter(regexp_extract_all({rest}, '\b(\d{{4}})\b'), lambda y: y BETWEEN '1900' AND '2099')")
    return ", ".join(steps), " || ".join(found)


def period_key(column: str) -> tuple[str, str]:
    """(column definitions, expression) for period_key."""
    steps, found = stated(column, False)
    text = fold(column)
    long = f"'undated:' || substr({text}, 1, 64) || '#' || substr(sha256({text}), 1, 16)"
    return steps, f"CASE WHEN _r0 = '' THEN 'undated' ELSE coalesce(({found})[1], CASE WHEN regexp_full_match(_r0, '(19|20)\\d{{2}}') THEN _r0 END, CASE WHEN length({text}) <= 64 THEN 'undated:' || {text} ELSE {long} END) END"


def span(key: str) -> tuple[str, str]:
    """First and last day of a period key, null where it has no range."""
    first = (
        f"CASE WHEN regexp_full_match({key}, '\\d{{4}}-(0[1-9]|1[0-2])') THEN try_cast({key} || '-01' AS DATE) "
        f"WHEN regexp_full_match({key}, '\\d{{4}}-Q[1-4]') THEN make_date(substr({key}, 1, 4)::INT, substr({key}, 7, 1)::INT * 3 - 2, 1) "
        f"WHEN regexp_full_match({key}, '\\d{{4}}') THEN make_date({key}::INT, 1, 1) END"
    )
    months = f"CASE WHEN {key} LIKE '%Q%' THEN 2 WHEN length({key}) = 4 THEN 11 ELSE 0 END"
    return first, f"last_day({first} + to_months({months}))::DATE"


_STEPS, _KEY = period_key("period_text")
_WRITTEN = ", ".join(f"('{form}', '{unit}')" for unit, forms in UNIT_WORDS.items() for form in forms)

#: CTE lf: the rows of ledger_facts.
LEDGER_FACTS = rf"""
names AS (SELECT slug, unnest([slug, label] || coalesce(aliases, [])) AS a FROM measure_defs),
aliases AS (SELECT lower(trim(a)) AS alias, min(slug) AS slug FROM names GROUP BY 1),
units AS (SELECT slug, unnest(units) AS u FROM measure_defs),
written(form, unit_id) AS (VALUES {_WRITTEN}),
once AS (SELECT * REPLACE (coalesce(unit_id, trim(unit)) AS unit) FROM facts LEFT JOIN written ON form = lower(trim(unit)) QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY ingested_at DESC NULLS LAST) = 1),
keyed AS (SELECT *, {_STEPS}, {_KEY} AS period_key, {fold('coalesce(entity, entity_quote)')} AS entity_key FROM once),
lf AS (
  SELECT k.* EXCLUDE (observed_at_text, form, unit_id), a.slug AS metric_slug, m.tolerance_kind, m.tolerance, u.u.to_canonical_factor AS factor,
         concat_ws('::', entity_key, a.slug, period_key) AS group_key,
         CASE WHEN abs(amount * u.u.to_canonical_factor) <= 9007199254740991 THEN amount * u.u.to_canonical_factor END AS canonical,
         CASE WHEN regexp_full_match(trim(observed_at_text), '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(trim(observed_at_text) AS DATE) END AS observed_on
  FROM keyed k LEFT JOIN aliases a ON lower(trim(k.metric)) = a.alias
  LEFT JOIN measure_defs m ON m.slug = a.slug LEFT JOIN units u ON u.slug = a.slug AND u.u.id = k.unit)
"""


def beyond(low: str, high: str) -> str:
    return f"(CASE WHEN tolerance_kind = 'absolute' THEN abs({high} - {low}) > tolerance WHEN greatest(abs({low}), abs({high})) = 0 THEN abs({high} - {low}) > 0 ELSE abs({high} - {low}) / greatest(abs({low}), abs({high})) > tolerance END)"


#: CTE cf: the rows of detect_conflicts, after lf.
CONFLICTS = f"""
cells AS (
  SELECT tenant_id, group_key, any_value(entity_key) AS entity_key, any_value(metric_slug) AS metric_slug, any_value(period_key) AS period_key,
         any_value(tolerance_kind) AS tolerance_kind, any_value(tolerance) AS tolerance, count(canonical) AS n_facts, count(*) - count(canonical) AS n_skipped,
         min(canonical) AS low, max(canonical) AS high, list_sort(list(fact_id) FILTER (canonical IS NOT NULL)) AS fact_ids
  FROM lf WHERE metric_slug IS NOT NULL AND entity_key IS NOT NULL GROUP BY tenant_id, group_key),
cf AS (SELECT tenant_id, group_key, entity_key, metric_slug, period_key, n_facts, n_skipped, high - low AS magnitude, fact_ids FROM cells WHERE n_facts >= 2 AND {beyond('low', 'high')})
"""

#: CTE sc: stored conflicts, once each.
STORED = """
sc AS (
  SELECT DISTINCT ON (conflict_id) conflict_id, tenant_id, group_key, list_sort(list_distinct(fact_ids)) AS fact_ids, magnitude, status,
         resolution.outcome AS outcome, resolution.winning_fact_id AS winning_fact_id, resolution.resolved_at AS resolved_at, created_at FROM conflicts)
"""
