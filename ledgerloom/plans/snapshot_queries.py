"""Queries of the general operators for data preparation: snapshots, units, moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import table
from ledgerloom.operators.snapshots import file_changes
from ledgerloom.operators.timestamps import fact_moments
from ledgerloom.operators.units import converted_facts, fact_units, inferred_units


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files added, removed or changed from one usable sweep to the next."""
    return file_changes(table(spark, folder, "file_states"), table(spark, folder, "source_sweeps"))


def p1_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Changes per source and kind."""
    return p1_found(spark, folder).groupBy("source_id", "change_kind").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Facts whose amount is given in a unit other than the canonical one."""
    return converted_facts(table(spark, folder, "facts"), table(spark, folder, "measure_defs"))


def p5_canonical_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every amount with its decoded unit and its value in the canonical unit."""
    return fact_units(table(spark, folder, "facts"), table(spark, folder, "measure_defs"))


def p5_inferred_units(spark: SparkSession, folder: str) -> DataFrame:
    """Facts whose unit only the chain tells, by the level of their series."""
    return inferred_units(table(spark, folder, "facts"), table(spark, folder, "measure_defs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Normal forms of periods and moments."""
    return fact_moments(table(spark, folder, "facts"), table(spark, folder, "sources"))


QUERIES = {f.__name__: f for f in (p1_found, p1_change_counts, p5_found, p5_canonical_amounts, p5_inferred_units, p6_found)}

_CHANGES = r"""
WITH listing AS (
  SELECT source_id, sweep_no, delivery_no,
         nfc_normalize(regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(?:\./)*/?(?:\./)*', '')) AS path,
         max(CASE WHEN withdrawn_at IS NULL THEN coalesce(regexp_replace(lower(trim(sha256)), '^(?:sha-?256:|0x)', ''), '') END) AS hash
  FROM file_states WHERE trim(path) <> '' GROUP BY ALL),
counts AS (SELECT source_id, sweep_no, delivery_no, count(*) AS n FROM listing GROUP BY ALL),
usable AS (
  SELECT s.source_id, s.sweep_no, max(s.delivery_no) AS delivery_no
  FROM source_sweeps s LEFT JOIN counts c USING (source_id, sweep_no, delivery_no)
  WHERE coalesce(c.n, 0) = s.file_count GROUP BY ALL),
pairs AS (SELECT *, lag(sweep_no) OVER (PARTITION BY source_id ORDER BY sweep_no) AS before FROM usable),
files AS (SELECT l.* FROM listing l JOIN usable USING (source_id, sweep_no, delivery_no) WHERE hash IS NOT NULL),
later AS (SELECT p.source_id, p.sweep_no, f.path, f.hash FROM pairs p JOIN files f USING (source_id, sweep_no) WHERE before IS NOT NULL),
earlier AS (SELECT p.source_id, p.sweep_no, f.path, f.hash FROM pairs p JOIN files f ON f.source_id = p.source_id AND f.sweep_no = p.before),
plus AS (SELECT * FROM later EXCEPT ALL SELECT * FROM earlier),
minus AS (SELECT * FROM earlier EXCEPT ALL SELECT * FROM later),
changes AS (
  SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.sweep_no, b.sweep_no) AS sweep_no, coalesce(a.path, b.path) AS path,
         CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM plus a FULL JOIN minus b ON a.source_id = b.source_id AND a.sweep_no = b.sweep_no AND a.path = b.path)
"""

ORACLE = {
    "p1_found": _CHANGES + "SELECT * FROM changes",
    "p1_change_counts": _CHANGES + "SELECT source_id, change_kind, count(*) AS n, count(DISTINCT path) AS n_paths FROM changes GROUP BY ALL",
}
