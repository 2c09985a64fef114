"""Queries over facts, conflicts and cells of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import scoped, table
from ledgerloom.functions.periods import period_end, period_granularity, period_start, stated_periods
from ledgerloom.functions.text import entity_fold, near_match_fold
from ledgerloom.operators.entities import near_matches, resolve_entities
from ledgerloom.operators.ledger import agree_facts, detect_conflicts, ledger_facts, propose_survivor, reconcile_conflicts, resolve_cells, stored_conflicts
from ledgerloom.plans.sql_parts import CONFLICTS, LEDGER_FACTS, STORED, beyond, fold, span, stated
from ledgerloom.storage import durable

TENANT = "t-000001"


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return ledger_facts(table(spark, folder, "facts"), table(spark, folder, "measure_defs"))


def _kept_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once, for plans that read them several times."""
    return durable(_facts(spark, folder).drop("raw_text"), "facts")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return stored_conflicts(table(spark, folder, "conflicts"))


def _flat(conflicts: DataFrame) -> DataFrame:
    return conflicts.withColumn("fact_ids", F.array_join("fact_ids", ",")).withColumn("magnitude", F.round("magnitude", 6))


def conflict_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Cells whose facts disagree beyond the measure's tolerance."""
    return _flat(detect_conflicts(_kept_facts(spark, folder)))


def conflict_scan_current_only(spark: SparkSession, folder: str) -> DataFrame:
    """The same over facts that no newer document version superseded (unknown counts as current)."""
    return _flat(detect_conflicts(_kept_facts(spark, folder).where("NOT coalesce(superseded, false)")))


def conflict_scan_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the cells touched since a date."""
    facts = _kept_facts(spark, folder)
    touched = facts.where("created_at >= TIMESTAMP '2024-10-01 00:00:00'").select("tenant_id", "group_key").distinct()
    return _flat(detect_conflicts(facts.join(touched, ["tenant_id", "group_key"], "left_semi")))


def conflict_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """What the scan does to the stored conflicts."""
    facts = _kept_facts(spark, folder)
    skipped = facts.where("metric_slug IS NOT NULL AND canonical IS NULL")
    return reconcile_conflicts(detect_conflicts(facts), _stored(spark, folder), skipped)


def survivorship_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed winners by authority or recency, over cells in conflict."""
    facts = _kept_facts(spark, folder)
    contested = detect_conflicts(facts).select("tenant_id", "group_key")
    return propose_survivor(facts.join(contested, ["tenant_id", "group_key"], "left_semi"), table(spark, folder, "measure_defs"))


def ledger_cells(spark: SparkSession, folder: str) -> DataFrame:
    """State and value of every cell."""
    return resolve_cells(_kept_facts(spark, folder), _stored(spark, folder)).withColumn("canonical", F.round("canonical", 6))


def ledger_cells_by_state(spark: SparkSession, folder: str) -> DataFrame:
    """Cells per tenant and state."""
    return ledger_cells(spark, folder).groupBy("tenant_id", "state").agg(F.count("*").alias("n_cells"))


def conflicted_cells(spark: SparkSession, folder: str) -> DataFrame:
    """A filter on the resolved state, as a list view applies it."""
    return ledger_cells(spark, folder).where("state = 'conflicted'").select("tenant_id", "group_key", "n_ids")


def ledger_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Facts and distinct measures of each entity."""
    return _facts(spark, folder).where("entity_key IS NOT NULL").groupBy("tenant_id", "entity_key").agg(F.count("*").alias("n_facts"), F.countDistinct("metric_slug").alias("n_metrics"))


def ledger_facts_page(spark: SparkSession, folder: str) -> DataFrame:
    """One page of a tenant's facts, newest first, with the total beside each row."""
    facts = scoped(_facts(spark, folder), TENANT)
    total = facts.agg(F.count("*").alias("total"))
    return facts.orderBy(F.col("created_at").desc(), "fact_id").select("fact_id", "entity_key", "metric_slug", "period_key").offset(20).limit(20).crossJoin(F.broadcast(total))


def agreed_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that at least two extraction methods agree on."""
    order = F.array_position(F.array(F.lit("llm"), F.lit("regex"), F.lit("manual")), F.col("extraction_method"))
    votes = _facts(spark, folder).withColumn("pass", order.cast("int")).where("pass > 0")
    return agree_facts(votes).withColumn("confidence", F.round("confidence", 6))


def fact_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """Active, withdrawn and superseded facts per source."""
    f = _facts(spark, folder)
    out, old = F.coalesce("withdrawn", F.lit(False)), F.coalesce("superseded", F.lit(False))
    return f.groupBy("source_id").agg(F.count_if(~out & ~old).alias("n_active"), F.count_if(out).alias("n_withdrawn"), F.count_if(old).alias("n_superseded"))


def source_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """Each fact's class and its source's, with defaults where a source is unknown."""
    s = table(spark, folder, "sources").groupBy("source_id").agg(F.max("source_class").alias("registered"), F.max("kind").alias("kind"))
    return _facts(spark, folder).join(s, "source_id", "left").groupBy(F.coalesce("source_class", F.lit("unclassified")).alias("fact_class"), F.coalesce("registered", F.lit("unclassified")).alias("source_class"), F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


def class_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per source that still carry a class other than the source's."""
    s = table(spark, folder, "sources").groupBy("source_id").agg(F.max("source_class").alias("registered"))
    drifted = F.coalesce(F.col("source_class") != F.col("registered"), F.lit(False))
    return _facts(spark, folder).join(s, "source_id").groupBy("source_id").agg(F.count_if(drifted).alias("n_drifted"))


def entity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per canonical entity of a registry, by exact folded name; names of several entities match none."""
    facts = table(spark, folder, "facts").select("source_id", "fact_id", F.coalesce("entity", "entity_quote").alias("name")).distinct()
    registry = registry_of(spark, folder)
    return resolve_entities(facts, registry).groupBy("canonical_name").agg(F.count("*").alias("n"))


def registry_of(spark: SparkSession, folder: str) -> DataFrame:
    """A registry derived from the ledger: its entities, and their quoted names as aliases where a row pairs them."""
    r = table(spark, folder, "ledger_resolutions").select(entity_fold(F.col("entity")).alias("canonical_name")).where("canonical_name <> ''").distinct()
    f = table(spark, folder, "facts").select(entity_fold(F.col("entity")).alias("canonical_name"), entity_fold(F.col("entity_quote")).alias("alias")).where("alias IS NOT NULL").distinct()
    return f.join(r, "canonical_name", "left_semi").unionByName(r.select("canonical_name", F.col("canonical_name").alias("alias"))).distinct()


def near_match_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Names of facts that no registered name equals, but one does when punctuation and suffixes are set aside."""
    facts = table(spark, folder, "facts").select("fact_id", F.coalesce("entity", "entity_quote").alias("name"), "created_at").distinct()
    return near_matches(facts, registry_of(spark, folder))


def period_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Granularity and range of each period key, with its facts."""
    k = F.col("period_key")
    return _facts(spark, folder).groupBy("period_key").agg(F.count("*").alias("n")).select("period_key", period_granularity(k).alias("granularity"), period_start(k).alias("first_day"), period_end(k).alias("last_day"), "n")


def stated_period_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each period is stated in the quotes of facts."""
    raw = table(spark, folder, "facts").select("fact_id", "raw_text").distinct()
    return raw.select(F.explode(stated_periods(F.col("raw_text"))).alias("period_key")).groupBy("period_key").agg(F.count("*").alias("n"))


def period_overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different periods of one entity and measure that overlap, by month buckets instead of a nested loop."""
    f = _facts(spark, folder).where("metric_slug IS NOT NULL AND entity_key IS NOT NULL").select("tenant_id", "entity_key", "metric_slug", "period_key").distinct()
    k = F.col("period_key")
    # Exploding drops periods without a range; a filter would be pushed down and repeat the whole reading of the period.
    ranged = f.withColumn("a", period_start(k)).withColumn("b", period_end(k))
    months = ranged.withColumn("month", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))))
    keys = ["tenant_id", "entity_key", "metric_slug", "month"]
    left = months.select(*keys, F.col("period_key").alias("period_a"))
    right = months.select(*keys, F.col("period_key").alias("period_b"))
    return left.join(right, keys).where("period_a < period_b").select("tenant_id", "entity_key", "metric_slug", "period_a", "period_b").distinct()


def newest_per_entity(spark: SparkSession, folder: str) -> DataFrame:
    """The newest fact of each entity."""
    w = Window.partitionBy("tenant_id", "entity_key").orderBy(F.col("created_at").desc(), "fact_id")
    return _facts(spark, folder).where("entity_key IS NOT NULL").withColumn("n", F.row_number().over(w)).where("n = 1").select("tenant_id", "entity_key", "fact_id")


def near_match_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The near-match form of every entity name of the ledger."""
    return table(spark, folder, "ledger_resolutions").select("entity").distinct().select("entity", near_match_fold(F.col("entity")).alias("near_key"))


QUERIES = {f.__name__: f for f in (conflict_scan, conflict_scan_current_only, conflict_scan_incremental, conflict_reconcile, survivorship_proposals, ledger_cells, ledger_cells_by_state, conflicted_cells, ledger_entities, ledger_facts_page, agreed_facts, fact_lifecycle, source_enrichment, class_drift, entity_resolution, near_match_aliases, period_keys, stated_period_counts, period_overlap_pairs, newest_per_entity, near_match_keys)}

_FLAT = "SELECT * REPLACE (array_to_string(fact_ids, ',') AS fact_ids, round(magnitude, 6) AS magnitude) FROM cf"
_CURRENT = LEDGER_FACTS.replace("lf AS (", "lf0 AS (") + ", lf AS (SELECT * FROM lf0 WHERE NOT coalesce(superseded, false))"
_TOUCHED = LEDGER_FACTS.replace("lf AS (", "lf0 AS (") + ", lf AS (SELECT * FROM lf0 WHERE (tenant_id, group_key) IN (SELECT (tenant_id, group_key) FROM lf0 WHERE created_at >= TIMESTAMP '2024-10-01 00:00:00'))"
_CELLS = f"""
WITH {LEDGER_FACTS}, {STORED},
act AS (SELECT *, NOT coalesce(withdrawn, false) AND NOT coalesce(superseded, false) AS active FROM lf WHERE metric_slug IS NOT NULL AND entity_key IS NOT NULL),
singles AS (SELECT tenant_id, group_key, canonical AS single FROM act WHERE active
  QUALIFY row_number() OVER (PARTITION BY tenant_id, group_key ORDER BY observed_on DESC NULLS LAST, created_at DESC, fact_id) = 1),
grp AS (SELECT tenant_id, group_key, count(*) FILTER (active) AS n_active, count(canonical) FILTER (active) AS n_values, min(canonical) FILTER (active) AS low, max(canonical) FILTER (active) AS high,
  any_value(tolerance_kind) AS tolerance_kind, any_value(tolerance) AS tolerance FROM act GROUP BY 1, 2),
opens AS (SELECT tenant_id, group_key, arg_min(conflict_id, (created_at, conflict_id)) AS open_id, arg_min(len(fact_ids), (created_at, conflict_id)) AS open_n FROM sc WHERE status = 'open' GROUP BY 1, 2),
ruled AS (SELECT tenant_id, group_key, conflict_id, canonical AS won, coalesce(withdrawn, false) AS won_withdrawn, len(fact_ids) AS n
  FROM (SELECT s.*, a.canonical, a.withdrawn FROM sc s JOIN act a ON a.tenant_id = s.tenant_id AND a.group_key = s.group_key AND a.fact_id = s.winning_fact_id WHERE s.status = 'resolved' AND s.outcome = 'resolved')
  QUALIFY row_number() OVER (PARTITION BY tenant_id, group_key ORDER BY resolved_at DESC, conflict_id DESC) = 1),
j AS (SELECT g.*, s.single, o.open_id, o.open_n, r.conflict_id AS ruled_id, r.won, r.won_withdrawn, r.n AS ruled_n,
  CASE WHEN o.open_id IS NOT NULL THEN 'conflicted' WHEN r.conflict_id IS NOT NULL THEN 'adjudicated' WHEN n_active = 0 THEN 'unknown' WHEN n_values >= 2 AND {beyond('low', 'high')} THEN 'conflicted' ELSE 'single' END AS state
  FROM grp g LEFT JOIN singles s USING (tenant_id, group_key) LEFT JOIN opens o USING (tenant_id, group_key) LEFT JOIN ruled r USING (tenant_id, group_key)),
cells AS (SELECT tenant_id, group_key, state, round(CASE state WHEN 'adjudicated' THEN won WHEN 'single' THEN single END, 6) AS canonical,
  CASE WHEN open_id IS NOT NULL THEN open_id WHEN state = 'adjudicated' THEN ruled_id END AS conflict_id, CASE WHEN state = 'adjudicated' THEN won_withdrawn END AS winner_withdrawn,
  CASE WHEN open_id IS NOT NULL THEN open_n WHEN state = 'adjudicated' THEN ruled_n WHEN state = 'unknown' THEN 0 ELSE n_active END AS n_ids FROM j)
"""
_S_STEPS, _S_LIST = stated("raw_text", True)
_FIRST, _LAST = span("period_key")
_REGISTRY = f"""
r AS (SELECT DISTINCT {fold('entity')} AS canonical_name FROM ledger_resolutions WHERE {fold('entity')} <> ''),
reg AS (SELECT DISTINCT {fold('entity')} AS canonical_name, {fold('entity_quote')} AS alias FROM facts WHERE entity_quote IS NOT NULL AND {fold('entity')} IN (SELECT canonical_name FROM r)
  UNION SELECT canonical_name, canonical_name FROM r)
"""
_NEAR = "trim(regexp_replace(trim(regexp_replace(regexp_replace(replace({0}, '&', 'and'), '[.,\\-]', ' ', 'g'), ' +', ' ', 'g')), ' (llc|inc|ltd|l ?p|corp)$', ''))"

ORACLE = {
    "conflict_scan": f"WITH {LEDGER_FACTS}, {CONFLICTS} {_FLAT}",
    "conflict_scan_current_only": f"WITH {_CURRENT}, {CONFLICTS} {_FLAT}",
    "conflict_scan_incremental": f"WITH {_TOUCHED}, {CONFLICTS} {_FLAT}",
    "conflict_reconcile": f"""
WITH {LEDGER_FACTS}, {CONFLICTS}, {STORED},
opens AS (SELECT tenant_id, group_key, arg_max(fact_ids, created_at) AS open_ids FROM sc WHERE status = 'open' GROUP BY 1, 2),
closed AS (SELECT tenant_id, group_key, list(DISTINCT array_to_string(fact_ids, ',')) AS closed_ids FROM sc WHERE status <> 'open' GROUP BY 1, 2),
skipped AS (SELECT DISTINCT tenant_id, group_key, true AS s FROM lf WHERE metric_slug IS NOT NULL AND canonical IS NULL),
m AS (SELECT coalesce(c.tenant_id, o.tenant_id) AS tenant_id, coalesce(c.group_key, o.group_key) AS group_key, c.fact_ids AS new_ids, o.open_ids
      FROM cf c FULL JOIN opens o ON c.tenant_id = o.tenant_id AND c.group_key = o.group_key)
SELECT m.tenant_id, m.group_key, CASE WHEN new_ids IS NOT NULL AND open_ids IS NOT NULL THEN CASE WHEN new_ids = open_ids THEN 'keep' ELSE 'grow' END
  WHEN new_ids IS NOT NULL THEN CASE WHEN list_contains(closed_ids, array_to_string(new_ids, ',')) THEN 'keep' ELSE 'insert' END
  WHEN s THEN 'keep' ELSE 'retract' END AS action
FROM m LEFT JOIN closed USING (tenant_id, group_key) LEFT JOIN skipped USING (tenant_id, group_key)""",
    "survivorship_proposals": f"""
WITH {LEDGER_FACTS}, {CONFLICTS},
f AS (SELECT l.*, d.authority_order, d.staleness_window_ms, nullif(coalesce(list_position(d.authority_order, l.source_class), 0), 0) AS rnk
      FROM lf l JOIN cf USING (tenant_id, group_key) JOIN measure_defs d ON d.slug = l.metric_slug),
b AS (SELECT *, min(rnk) OVER (PARTITION BY tenant_id, group_key) AS best FROM f),
o AS (SELECT *, coalesce((rnk = best)::INT, 0) AS top FROM b),
n AS (SELECT *, row_number() OVER w AS rn, lead(observed_on) OVER w AS nxt FROM o WINDOW w AS (PARTITION BY tenant_id, group_key ORDER BY top DESC, observed_on DESC NULLS LAST, created_at DESC, fact_id)),
c AS (SELECT tenant_id, group_key, count(*) AS n, any_value(authority_order) AS ao, any_value(staleness_window_ms) AS win, bool_or(coalesce(source_class, 'unclassified') = 'unclassified') AS unc, bool_or(rnk IS NULL) AS outside,
  sum(top) AS n_top, bool_or(top = 1 AND observed_on IS NULL) AS unob, max(fact_id) FILTER (rn = 1) AS first_id, max(observed_on - nxt) FILTER (rn = 1) AS gap FROM n GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN n < 2 THEN 'too-few-facts' WHEN ao IS NULL OR len(ao) = 0 THEN 'no-authority-order' WHEN len(ao) <> len(list_distinct(ao)) THEN 'authority-order-repeats'
  WHEN unc THEN 'fact-unclassified' WHEN outside THEN 'class-outside-order' WHEN n_top = 1 THEN 'highest-authority' WHEN unob THEN 'tie-unobserved' WHEN win IS NULL THEN 'no-staleness-window'
  WHEN gap::DOUBLE * 86400000 > win THEN 'freshest-of-tie' ELSE 'gap-within-window' END AS reason FROM c)
SELECT tenant_id, group_key, CASE reason WHEN 'highest-authority' THEN 'authority' WHEN 'freshest-of-tie' THEN 'recency' ELSE 'none' END AS basis, reason,
  CASE WHEN reason IN ('highest-authority', 'freshest-of-tie') THEN first_id END AS fact_id FROM q""",
    "ledger_cells": _CELLS + "SELECT * FROM cells",
    "ledger_cells_by_state": _CELLS + "SELECT tenant_id, state, count(*) AS n_cells FROM cells GROUP BY ALL",
    "conflicted_cells": _CELLS + "SELECT tenant_id, group_key, n_ids FROM cells WHERE state = 'conflicted'",
    "ledger_entities": f"WITH {LEDGER_FACTS} SELECT tenant_id, entity_key, count(*) AS n_facts, count(DISTINCT metric_slug) AS n_metrics FROM lf WHERE entity_key IS NOT NULL GROUP BY ALL",
    "ledger_facts_page": f"WITH {LEDGER_FACTS}, p AS (SELECT *, count(*) OVER () AS total FROM lf WHERE tenant_id = '{TENANT}') SELECT fact_id, entity_key, metric_slug, period_key, total FROM p ORDER BY created_at DESC, fact_id LIMIT 20 OFFSET 20",
    "agreed_facts": f"""
WITH {LEDGER_FACTS}, v0 AS (SELECT *, list_position(['llm', 'regex', 'manual'], extraction_method) AS pass FROM lf WHERE canonical IS NOT NULL AND metric_slug IS NOT NULL),
v AS (SELECT * FROM v0 WHERE pass > 0 QUALIFY row_number() OVER (PARTITION BY tenant_id, group_key, pass, canonical ORDER BY fact_id) = 1),
near AS (SELECT p.tenant_id, p.group_key, p.pass AS pp, p.fact_id AS pf, v.pass, v.fact_id, v.confidence FROM v p JOIN v ON p.tenant_id = v.tenant_id AND p.group_key = v.group_key
  WHERE NOT (CASE WHEN v.tolerance_kind = 'absolute' THEN abs(p.canonical - v.canonical) > v.tolerance WHEN greatest(abs(p.canonical), abs(v.canonical)) = 0 THEN false
    ELSE abs(p.canonical - v.canonical) / greatest(abs(p.canonical), abs(v.canonical)) > v.tolerance END)),
firsts AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY tenant_id, group_key, pp, pf, pass ORDER BY fact_id) = 1),
sets AS (SELECT tenant_id, group_key, pp, pf, count(*) AS n, avg(confidence) AS confidence, arg_min(fact_id, pass) AS fact_id FROM firsts GROUP BY 1, 2, 3, 4)
SELECT tenant_id, group_key, fact_id, n AS n_passes, round(confidence, 6) AS confidence FROM (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY tenant_id, group_key ORDER BY n DESC, pp, pf) = 1) WHERE n >= 2""",
    "fact_lifecycle": f"WITH {LEDGER_FACTS}, x AS (SELECT source_id, coalesce(withdrawn, false) AS w, coalesce(superseded, false) AS s FROM lf) SELECT source_id, count(*) FILTER (NOT w AND NOT s) AS n_active, count(*) FILTER (w) AS n_withdrawn, count(*) FILTER (s) AS n_superseded FROM x GROUP BY 1",
    "source_enrichment": f"WITH {LEDGER_FACTS}, s AS (SELECT source_id, max(source_class) AS registered, max(kind) AS kind FROM sources GROUP BY 1) SELECT coalesce(l.source_class, 'unclassified') AS fact_class, coalesce(registered, 'unclassified') AS source_class, coalesce(kind, 'unknown') AS kind, count(*) AS n FROM lf l LEFT JOIN s USING (source_id) GROUP BY 1, 2, 3",
    "class_drift": f"WITH {LEDGER_FACTS}, s AS (SELECT source_id, max(source_class) AS registered FROM sources GROUP BY 1) SELECT source_id, count(*) FILTER (l.source_class <> registered) AS n_drifted FROM lf l JOIN s USING (source_id) GROUP BY 1",
    "entity_resolution": f"WITH {_REGISTRY}, one AS (SELECT alias, min(canonical_name) AS canonical_name FROM reg GROUP BY 1 HAVING count(DISTINCT canonical_name) = 1), n AS (SELECT DISTINCT source_id, fact_id, coalesce(entity, entity_quote) AS name FROM facts) SELECT canonical_name, count(*) AS n FROM n LEFT JOIN one ON {fold('name')} = alias GROUP BY 1",
    "near_match_aliases": f"""
WITH {_REGISTRY}, n AS (SELECT {fold('coalesce(entity, entity_quote)')} AS name, max((created_at, fact_id)) AS newest FROM facts WHERE coalesce(entity, entity_quote) IS NOT NULL GROUP BY 1),
k AS (SELECT {_NEAR.format('alias')} AS key, min(canonical_name) AS canonical_name FROM reg GROUP BY 1 HAVING count(DISTINCT canonical_name) = 1)
SELECT name, newest[2] AS fact_id, canonical_name FROM n JOIN k ON {_NEAR.format('name')} = key WHERE key <> '' AND name NOT IN (SELECT alias FROM reg)""",
    "period_keys": f"""WITH {LEDGER_FACTS}, k AS (SELECT period_key, count(*) AS n FROM lf GROUP BY 1)
SELECT period_key, CASE WHEN period_key = 'undated' THEN 'unstated' WHEN regexp_full_match(period_key, 'FY\\d{{4}}') THEN 'fiscal-year' WHEN regexp_full_match(period_key, '\\d{{4}}-Q[1-4]') THEN 'quarter'
  WHEN regexp_full_match(period_key, '\\d{{4}}-(0[1-9]|1[0-2])') THEN 'month' WHEN regexp_full_match(period_key, '\\d{{4}}') THEN 'year' ELSE 'unparseable' END AS granularity, {_FIRST} AS first_day, {_LAST} AS last_day, n FROM k""",
    "stated_period_counts": f"WITH d AS (SELECT DISTINCT fact_id, raw_text FROM facts), s AS (SELECT {_S_STEPS}, unnest(list_distinct({_S_LIST})) AS period_key FROM d) SELECT period_key, count(*) AS n FROM s GROUP BY 1",
    "period_overlap_pairs": f"""WITH {LEDGER_FACTS}, f AS (SELECT DISTINCT tenant_id, entity_key, metric_slug, period_key FROM lf WHERE metric_slug IS NOT NULL AND entity_key IS NOT NULL), s AS (SELECT *, {_FIRST} AS a, {_LAST} AS b FROM f)
SELECT x.tenant_id, x.entity_key, x.metric_slug, x.period_key AS period_a, y.period_key AS period_b FROM s x JOIN s y ON x.tenant_id = y.tenant_id AND x.entity_key = y.entity_key AND x.metric_slug = y.metric_slug AND x.period_key < y.period_key AND x.a <= y.b AND y.a <= x.b""",
    "newest_per_entity": f"WITH {LEDGER_FACTS} SELECT tenant_id, entity_key, fact_id FROM lf WHERE entity_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant_id, entity_key ORDER BY created_at DESC, fact_id) = 1",
    "near_match_keys": f"SELECT DISTINCT entity, {_NEAR.format(fold('entity'))} AS near_key FROM ledger_resolutions",
}
