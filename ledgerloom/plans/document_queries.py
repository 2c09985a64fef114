"""Queries over documents, versions, conflicts' members, listings and event streams (in their batch form)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import scoped, table
from ledgerloom.operators.documents import content_hash, corpus_fingerprint, duplicate_documents, in_batches, measure_faults, members_of, most_concurrent, number_versions, prune_conflicts, sweep_withdrawals, within_budget
from ledgerloom.operators.ledger import ledger_facts, stored_conflicts
from ledgerloom.operators.snapshots import canonical_path
from ledgerloom.plans.sql_parts import LEDGER_FACTS, STORED

TENANT = "t-000001"


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The content hash of every document."""
    return table(spark, folder, "documents").select("doc_id", content_hash(F.col("text")).alias("sha256"))


def duplicate_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Contents that a tenant holds more than once."""
    return duplicate_documents(table(spark, folder, "documents")).where("n_copies > 1")


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts").groupBy("document_id", "document_version_id").agg(F.min("created_at").alias("created_at"))


def document_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions numbered per document, and the current one."""
    return number_versions(_versions(spark, folder)).select("document_id", "document_version_id", "version_number", "is_current")


def superseded_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per document that belong to a version before the current one."""
    v = number_versions(_versions(spark, folder)).select("document_version_id", "document_id", "is_current")
    facts = table(spark, folder, "facts").select("fact_id", "document_id", "document_version_id").distinct()
    return facts.join(v, ["document_id", "document_version_id"], "left").groupBy("document_id").agg(F.count_if(~F.col("is_current")).alias("n_superseded"), F.count("*").alias("n"))


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Conflicts after the facts of every fifth source are removed with their documents."""
    gone = table(spark, folder, "facts").where("source_id % 5 = 0")
    pruned = prune_conflicts(stored_conflicts(table(spark, folder, "conflicts")), gone).where("pruned > 0")
    return pruned.withColumn("fact_ids", F.array_join("fact_ids", ","))


def withdrawn_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents all of whose facts are withdrawn, and those with some."""
    w = F.coalesce("withdrawn", F.lit(False))
    f = table(spark, folder, "facts").groupBy("document_id").agg(F.bool_and(w).alias("all_withdrawn"), F.bool_or(w).alias("some_withdrawn"))
    return f.groupBy("all_withdrawn", "some_withdrawn").agg(F.count("*").alias("n"))


def conflict_members(spark: SparkSession, folder: str) -> DataFrame:
    """How many members of each stored conflict exist as facts."""
    return members_of(stored_conflicts(table(spark, folder, "conflicts")), table(spark, folder, "facts"))


def touched_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Open conflicts that name a fact of a regex extraction (a semi join over the exploded members)."""
    c = stored_conflicts(table(spark, folder, "conflicts")).where("status = 'open'")
    hit = table(spark, folder, "facts").where("extraction_method = 'regex'").select("fact_id")
    ids = c.select("conflict_id", F.explode("fact_ids").alias("fact_id")).join(hit, "fact_id", "left_semi").select("conflict_id").distinct()
    return c.join(ids, "conflict_id", "left_semi").select("conflict_id", "group_key")


def restatements(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with at least two different values."""
    f = ledger_facts(table(spark, folder, "facts"), table(spark, folder, "measure_defs")).where("canonical IS NOT NULL AND entity_key IS NOT NULL AND metric_slug IS NOT NULL")
    return f.groupBy("tenant_id", "group_key").agg(F.countDistinct("canonical").alias("n_values"), F.min("canonical").alias("low"), F.max("canonical").alias("high")).where("n_values > 1")


def first_per_version(spark: SparkSession, folder: str) -> DataFrame:
    """The first fact of each document version and metric."""
    w = Window.partitionBy("document_version_id", "metric").orderBy("created_at", "fact_id", "ingested_at")
    return table(spark, folder, "facts").withColumn("n", F.row_number().over(w)).where("n = 1").select("document_version_id", "metric", "fact_id")


def budget_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each data room, oldest first, up to 20,000 characters."""
    d = table(spark, folder, "documents").select("source", "doc_id", "ingested_at", F.length("text").alias("n"))
    return within_budget(d, ["source"], ["ingested_at", "doc_id"], "n", 20_000).select("source", "doc_id", "running")


def paragraph_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of each version that fit 805 tokens from the start."""
    p = table(spark, folder, "docx_paragraphs").groupBy("document_version_id", "paragraph_index").agg(F.max(F.ceil(F.length("text") / 4)).alias("n"))
    return within_budget(p, ["document_version_id"], ["paragraph_index"], "n", 805).select("document_version_id", "paragraph_index", "running")


def fact_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each source in batches of 25."""
    f = table(spark, folder, "facts").select("source_id", "fact_id").distinct()
    return in_batches(f, ["source_id"], ["fact_id"], 25).groupBy("source_id", "batch_no").agg(F.count("*").alias("n"))


def fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of the corpus."""
    return corpus_fingerprint(table(spark, folder, "documents"), "doc_id")


def audit_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of purchases of a half-open week, newest first."""
    e = table(spark, folder, "events").where("ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00' AND event_type = 'purchase'")
    return e.orderBy(F.col("ts").desc(), "event_id").select("event_id", "user_id", "value").offset(20).limit(20)


def events_in_range(spark: SparkSession, folder: str) -> DataFrame:
    """Events per type of an inclusive range."""
    return table(spark, folder, "events").where("ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:59:59'").groupBy("event_type").agg(F.count("*").alias("n"))


def source_search(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose name, path or owner holds a text, letter case aside."""
    q = "PORTAL".lower()
    hit = F.lit(False)
    for c in ("source_name", "path", "owner"):
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return table(spark, folder, "sources").where(hit).select("source_id", "source_name")


def dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """One row of counts over several tables."""
    f = table(spark, folder, "facts").agg(F.count("*").alias("facts"), F.count_if("withdrawn").alias("facts_withdrawn"), F.count_if("superseded").alias("facts_superseded"))
    c = stored_conflicts(table(spark, folder, "conflicts")).agg(F.count_if(F.col("status") == "open").alias("conflicts_open"), F.count_if(F.col("status") == "resolved").alias("conflicts_resolved"))
    s = table(spark, folder, "sources").agg(F.count_if("enabled").alias("sources_enabled"), F.count_if(F.col("owner").isNull()).alias("sources_unowned"))
    d = table(spark, folder, "documents").agg(F.count("*").alias("documents"), F.bool_or(F.col("title").isNull()).alias("has_untitled"))
    return reduce(lambda a, b: a.crossJoin(b), (f, c, s, d))  # rows of one


def tenant_purge_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Rows a purge of one tenant would delete, per table."""
    names = ("conflicts", "documents", "facts", "ledger_resolutions", "sources")
    return reduce(DataFrame.unionByName, [scoped(table(spark, folder, n), TENANT).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names])


def measure_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of the measure definitions and of three broken ones."""
    broken = spark.createDataFrame([("Bad Slug", "x", ["entry yield"], "usd", [("usd", 1.0)], 0.1), ("two_ones", "", ["a"], "usd", [("usd", 1.0), ("eur", 1.0)], 0.1), ("no_one", "y", None, "usd", [("k", -1.0)], -0.1)], "slug string, label string, aliases array<string>, canonical_unit string, units array<struct<id:string,to_canonical_factor:double>>, tolerance double")
    return measure_faults(table(spark, folder, "measure_defs").select(*broken.columns).unionByName(broken))


def measure_order(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions with those of status confirmed first, then by slug."""
    w = Window.orderBy(F.when(F.col("status") == "confirmed", 0).otherwise(1), "slug")
    return table(spark, folder, "measure_defs").select("slug", F.row_number().over(w).alias("place"))


def spend_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Value per user and UTC day, and how many events fit a daily ceiling when taken in order."""
    e = table(spark, folder, "events").withColumn("day", F.date_trunc("day", "ts").cast("date"))
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("running", F.sum("value").over(w)).groupBy("user_id", "day").agg(F.round(F.sum("value"), 4).alias("spent"), F.count_if(F.col("running") <= 100).alias("n_within"))


def rate_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Quarter hours in which a type came at more than three times its rate of the two hours up to their end."""
    q = table(spark, folder, "events").groupBy("event_type", (F.floor(F.unix_seconds("ts") / 900)).alias("slot")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("slot").rangeBetween(-7, 0)
    return q.withColumn("n_two_hours", F.sum("n").over(w)).where(F.col("n") > 3 * F.col("n_two_hours") / 8)


def distinct_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user that differ in type from the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events").withColumn("before", F.lag("event_type").over(w))
    return e.where(~F.col("event_type").eqNullSafe(F.col("before"))).groupBy("user_id").agg(F.count("*").alias("n_changes"))


def concurrent_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The most half-day sessions a user has open at once, one session per event."""
    e = table(spark, folder, "events").select("user_id", "ts", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("until"))
    return most_concurrent(e, "user_id", "ts", "until")


def rate_limited(spark: SparkSession, folder: str) -> DataFrame:
    """Hours in which a user exceeds two events."""
    return table(spark, folder, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).where("n > 2")


def stale_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    """Failed sweeps older than thirty days before the last delivery of all."""
    s = table(spark, folder, "source_sweeps")
    last = s.agg(F.max("delivered_at").alias("last"))
    return s.crossJoin(F.broadcast(last)).where("sync_status = 'failed' AND delivered_at < last - INTERVAL 30 DAYS").groupBy("source_id").agg(F.count("*").alias("n"))


def withdrawn_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files two consecutive sweeps did not list."""
    f = table(spark, folder, "file_states").select("source_id", "sweep_no", canonical_path(F.col("path")).alias("path"))
    s = table(spark, folder, "source_sweeps").where("file_count IS NOT NULL").select("source_id", "sweep_no")
    return sweep_withdrawals(f, s)


QUERIES = {f.__name__: f for f in (content_hashes, duplicate_contents, document_versions, superseded_facts, cascade_delete, withdrawn_documents, conflict_members, touched_conflicts, restatements, first_per_version, budget_walk, paragraph_prefixes, fact_batches, fingerprint, audit_page, events_in_range, source_search, dashboard, tenant_purge_plan, measure_validation, measure_order, spend_windows, rate_alerts, distinct_changes, concurrent_sessions, rate_limited, stale_sweeps, withdrawn_files)}

_VERSIONS = "v0 AS (SELECT document_id, document_version_id, min(created_at) AS created_at FROM facts GROUP BY 1, 2), v AS (SELECT *, row_number() OVER w AS version_number, row_number() OVER w = count(*) OVER (PARTITION BY document_id) AS is_current FROM v0 WINDOW w AS (PARTITION BY document_id ORDER BY created_at, document_version_id))"

ORACLE = {
    "content_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "duplicate_contents": "SELECT tenant_id, sha256(text) AS sha256, arg_min(doc_id, (ingested_at, doc_id)) AS kept_id, count(*) AS n_copies FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "document_versions": f"WITH {_VERSIONS} SELECT document_id, document_version_id, version_number, is_current FROM v",
    "superseded_facts": f"WITH {_VERSIONS}, f AS (SELECT DISTINCT fact_id, document_id, document_version_id FROM facts) SELECT document_id, count(*) FILTER (NOT is_current) AS n_superseded, count(*) AS n FROM f LEFT JOIN v USING (document_id, document_version_id) GROUP BY 1",
    "cascade_delete": f"""WITH {STORED}, gone AS (SELECT DISTINCT fact_id FROM facts WHERE source_id % 5 = 0),
m AS (SELECT conflict_id, status, outcome, unnest(fact_ids) AS fact_id FROM sc),
k AS (SELECT conflict_id, status, outcome, list_sort(list(m.fact_id) FILTER (g.fact_id IS NULL)) AS ids, count(g.fact_id) AS pruned FROM m LEFT JOIN gone g USING (fact_id) GROUP BY 1, 2, 3)
SELECT conflict_id, coalesce(array_to_string(ids, ','), '') AS fact_ids, CASE WHEN status = 'open' AND coalesce(len(ids), 0) < 2 THEN 'resolved' ELSE status END AS status, CASE WHEN status = 'open' AND coalesce(len(ids), 0) < 2 THEN 'superseded' ELSE outcome END AS outcome, pruned FROM k WHERE pruned > 0""",
    "withdrawn_documents": "WITH f AS (SELECT document_id, bool_and(coalesce(withdrawn, false)) AS all_withdrawn, bool_or(coalesce(withdrawn, false)) AS some_withdrawn FROM facts GROUP BY 1) SELECT all_withdrawn, some_withdrawn, count(*) AS n FROM f GROUP BY 1, 2",
    "conflict_members": f"WITH {STORED}, m AS (SELECT conflict_id, unnest(fact_ids) AS fact_id FROM sc) SELECT conflict_id, count(*) AS n_members, count(*) FILTER (fact_id IN (SELECT fact_id FROM facts)) AS n_found, count(*) = count(*) FILTER (fact_id IN (SELECT fact_id FROM facts)) AS complete FROM m GROUP BY 1",
    "touched_conflicts": f"WITH {STORED} SELECT conflict_id, group_key FROM sc WHERE status = 'open' AND list_has_any(fact_ids, (SELECT list(fact_id) FROM facts WHERE extraction_method = 'regex'))",
    "restatements": f"WITH {LEDGER_FACTS} SELECT tenant_id, group_key, count(DISTINCT canonical) AS n_values, min(canonical) AS low, max(canonical) AS high FROM lf WHERE canonical IS NOT NULL AND entity_key IS NOT NULL AND metric_slug IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT canonical) > 1",
    "first_per_version": "SELECT document_version_id, metric, fact_id FROM facts QUALIFY row_number() OVER (PARTITION BY document_version_id, metric ORDER BY created_at, fact_id, ingested_at) = 1",
    "budget_walk": "WITH d AS (SELECT source, doc_id, ingested_at, length(text) AS n FROM documents), r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY ingested_at, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM d) SELECT source, doc_id, running::BIGINT AS running FROM r WHERE running <= 20000",
    "paragraph_prefixes": "WITH p AS (SELECT document_version_id, paragraph_index, coalesce(max(ceil(length(text)::DOUBLE / 4)), 0)::BIGINT AS n FROM docx_paragraphs GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY document_version_id ORDER BY paragraph_index ROWS UNBOUNDED PRECEDING) AS running FROM p) SELECT document_version_id, paragraph_index, running::BIGINT AS running FROM r WHERE running <= 805",
    "fact_batches": "WITH f AS (SELECT DISTINCT source_id, fact_id FROM facts), b AS (SELECT source_id, ((row_number() OVER (PARTITION BY source_id ORDER BY fact_id) - 1) // 25)::INT AS batch_no FROM f) SELECT source_id, batch_no, count(*) AS n FROM b GROUP BY 1, 2",
    "audit_page": "SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20",
    "events_in_range": "SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-14 23:59:59' GROUP BY 1",
    "source_search": "SELECT source_id, source_name FROM sources WHERE contains(lower(source_name), 'portal') OR contains(lower(path), 'portal') OR coalesce(contains(lower(owner), 'portal'), false)",
    "dashboard": f"""WITH {STORED} SELECT (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM facts WHERE withdrawn) AS facts_withdrawn, (SELECT count(*) FROM facts WHERE superseded) AS facts_superseded,
(SELECT count(*) FROM sc WHERE status = 'open') AS conflicts_open, (SELECT count(*) FROM sc WHERE status = 'resolved') AS conflicts_resolved, (SELECT count(*) FROM sources WHERE enabled) AS sources_enabled,
(SELECT count(*) FROM sources WHERE owner IS NULL) AS sources_unowned, (SELECT count(*) FROM documents) AS documents, (SELECT bool_or(title IS NULL) FROM documents) AS has_untitled""",
    "tenant_purge_plan": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n} WHERE tenant_id = '{TENANT}'" for n in ("conflicts", "documents", "facts", "ledger_resolutions", "sources")),
    "measure_validation": "SELECT * FROM (VALUES ('Bad Slug', 'slug'), ('two_ones', 'label'), ('two_ones', 'canonical-unit'), ('no_one', 'canonical-unit'), ('no_one', 'factor'), ('no_one', 'tolerance'), ('Bad Slug', 'alias-shared'), ('going_in_yield', 'alias-shared')) t(slug, fault)",
    "measure_order": "SELECT slug, row_number() OVER (ORDER BY CASE WHEN status = 'confirmed' THEN 0 ELSE 1 END, slug) AS place FROM measure_defs",
    "spend_windows": "WITH e AS (SELECT *, ts::DATE AS day, sum(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events) SELECT user_id, day, round(sum(value), 4) AS spent, count(*) FILTER (running <= 100) AS n_within FROM e GROUP BY 1, 2",
    "rate_alerts": "WITH q AS (SELECT event_type, floor(epoch(ts) / 900)::BIGINT AS slot, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, (sum(n) OVER (PARTITION BY event_type ORDER BY slot RANGE BETWEEN 7 PRECEDING AND CURRENT ROW))::BIGINT AS n_two_hours FROM q) SELECT * FROM w WHERE n > 3.0 * n_two_hours / 8",
    "distinct_changes": "WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) AS n_changes FROM e WHERE event_type IS DISTINCT FROM before GROUP BY 1",
    "concurrent_sessions": "WITH e AS (SELECT user_id, ts AS place, 1 AS d FROM events UNION ALL SELECT user_id, ts + INTERVAL 12 HOURS, -1 FROM events), r AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY place, d ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, max(n)::BIGINT AS most FROM r GROUP BY 1",
    "rate_limited": "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2",
    "stale_sweeps": "SELECT source_id, count(*) AS n FROM source_sweeps WHERE sync_status = 'failed' AND delivered_at < (SELECT max(delivered_at) FROM source_sweeps) - INTERVAL 30 DAYS GROUP BY 1",
    "withdrawn_files": r"""
WITH p AS (SELECT DISTINCT source_id, sweep_no, nfc_normalize(regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(?:\./)*/?(?:\./)*', '')) AS path FROM file_states),
s AS (SELECT DISTINCT source_id, sweep_no FROM source_sweeps WHERE file_count IS NOT NULL), n AS (SELECT *, lead(sweep_no) OVER (PARTITION BY source_id ORDER BY sweep_no) AS nxt FROM s),
e AS (SELECT source_id, nxt AS sweep_no, path FROM p JOIN n USING (source_id, sweep_no) WHERE nxt IS NOT NULL),
r AS (SELECT e.source_id, e.sweep_no, count(*) AS n_expected, count(*) FILTER (q.path IS NULL) AS n_missing FROM e LEFT JOIN p q ON q.source_id = e.source_id AND q.sweep_no = e.sweep_no AND q.path = e.path GROUP BY 1, 2),
c AS (SELECT source_id, sweep_no, row_number() OVER (PARTITION BY source_id ORDER BY sweep_no) AS place FROM s WHERE (source_id, sweep_no) NOT IN (SELECT (source_id, sweep_no) FROM r WHERE n_missing > 0.5 * n_expected)),
g AS (SELECT p.source_id, path, place, lead(place) OVER (PARTITION BY p.source_id, path ORDER BY place) AS again, (SELECT max(place) FROM c z WHERE z.source_id = p.source_id) AS last FROM p JOIN c USING (source_id, sweep_no))
SELECT g.source_id, path, c.sweep_no FROM g JOIN c ON c.source_id = g.source_id AND c.place = g.place + 2 WHERE coalesce(again - 1, last) - g.place >= 2""",
}
