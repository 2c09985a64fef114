"""Streams run to their end, and the batch SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import table
from ledgerloom.operators.snapshots import canonical_hash, canonical_path, delivered_listing, usable_sweeps
from ledgerloom.streaming.operators import daily_sums, first_sightings, follow_files, quarter_hour_counts
from ledgerloom.streaming.tables import run_to_table, table_stream


def spend_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sums per event type."""
    return run_to_table(daily_sums(table_stream(spark, folder, "events")), "complete").withColumn("total", F.round("total", 4))


def first_seen_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of user and event type, each when it is first seen."""
    return run_to_table(first_sightings(table_stream(spark, folder, "events").select("user_id", "event_type"), ["user_id", "event_type"]), "append")


def sliding_counts_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding two-hour counts."""
    return run_to_table(quarter_hour_counts(table_stream(spark, folder, "events")), "complete")


def file_changes_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of each file entry by entry, kept in state.

    All deliveries are fed; of each sweep the highest complete one counts, and sweeps without one are passed over.
    """
    usable = usable_sweeps(delivered_listing(table(spark, folder, "file_states")), table(spark, folder, "source_sweeps"))
    e = table_stream(spark, folder, "file_states").where("path IS NOT NULL AND trim(path) <> ''").join(usable, ["source_id", "sweep_no", "delivery_no"])
    entries = e.select("source_id", canonical_path(F.col("path")).alias("path"), "sweep_no", canonical_hash(F.col("sha256")).alias("hash"), F.col("withdrawn_at").isNotNull().alias("withdrawn"))
    return run_to_table(follow_files(entries), "append").groupBy("source_id", "change_kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (spend_stream, first_seen_stream, sliding_counts_stream, file_changes_stream)}

ORACLE = {
    "spend_stream": "SELECT ts::DATE AS day, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2",
    "first_seen_stream": "SELECT DISTINCT user_id, event_type FROM events",
    "sliding_counts_stream": "WITH s AS (SELECT event_type, unnest(range(0, 8)) AS k, ts FROM events) SELECT time_bucket(INTERVAL 15 MINUTES, ts) - k * INTERVAL 15 MINUTES AS start, event_type, count(*) AS n FROM s GROUP BY 1, 2",
    "file_changes_stream": r"""
WITH counts AS (SELECT source_id, sweep_no, delivery_no, count(DISTINCT nfc_normalize(regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(?:\./)*/?(?:\./)*', ''))) AS n FROM file_states WHERE trim(path) <> '' GROUP BY ALL),
usable AS (SELECT s.source_id, s.sweep_no, max(s.delivery_no) AS delivery_no FROM source_sweeps s LEFT JOIN counts c USING (source_id, sweep_no, delivery_no) WHERE coalesce(c.n, 0) = s.file_count GROUP BY ALL),
e AS (SELECT DISTINCT source_id, sweep_no, nfc_normalize(regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(?:\./)*/?(?:\./)*', '')) AS path,
  coalesce(regexp_replace(lower(trim(sha256)), '^(?:sha-?256:|0x)', ''), '') AS hash, withdrawn_at IS NOT NULL AS w FROM file_states JOIN usable USING (source_id, sweep_no, delivery_no) WHERE trim(path) <> ''),
o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source_id, path, sweep_no ORDER BY hash) = 1),
l AS (SELECT *, lag(w) OVER p AS w0, last_value(CASE WHEN NOT w THEN hash END IGNORE NULLS) OVER (PARTITION BY source_id, path ORDER BY sweep_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h0 FROM o WINDOW p AS (PARTITION BY source_id, path ORDER BY sweep_no)),
k AS (SELECT source_id, CASE WHEN NOT w AND coalesce(w0, true) THEN 'added' WHEN w AND NOT coalesce(w0, true) THEN 'removed' WHEN NOT w AND hash IS DISTINCT FROM h0 THEN 'changed' END AS change_kind FROM l)
SELECT source_id, change_kind, count(*) AS n FROM k WHERE change_kind IS NOT NULL GROUP BY 1, 2""",
}
