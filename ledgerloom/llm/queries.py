"""Queries of the operators for training text, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.catalog import table
from ledgerloom.llm.languages import document_languages, fit_on, language_stretches, unlabelled_languages
from ledgerloom.llm.leaks import find_leaks
from ledgerloom.llm.mapping import free_metrics
from ledgerloom.llm.names import link_names, linked_pairs
from ledgerloom.llm.packing import pack_documents, packing_summary
from ledgerloom.llm.segmentation import oversized, split_paragraphs
from ledgerloom.llm.survivors import LATEST, survivors


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Different spellings of one entity in a source."""
    return linked_pairs(table(spark, folder, "facts"))


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with the cluster it belongs to."""
    facts = table(spark, folder, "facts")
    names = facts.selectExpr("source_id", "entity_quote AS name").unionAll(facts.selectExpr("source_id", "entity AS name"))
    return link_names(names, "source_id", "name")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The record each surviving field of a cell is from."""
    return survivors(table(spark, folder, "ledger_resolutions"), LATEST).select("group_id", "fact_ids_from", "conflict_id_from", "decision_from", "state_from")


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each cell, as the votes of all its records decide."""
    return survivors(table(spark, folder, "ledger_resolutions"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that come out in several pieces."""
    return oversized(table(spark, folder, "docx_paragraphs"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all paragraphs."""
    return split_paragraphs(table(spark, folder, "docx_paragraphs"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The measure each freely typed metric means."""
    return free_metrics(table(spark, folder, "facts"), table(spark, folder, "measure_defs"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    return pack_documents(table(spark, folder, "documents"))


def p8_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers there are, how few there could be, and how much room is unused."""
    return packing_summary(p8_containers(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that give away evaluation items."""
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks with their length and place."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of a text that its label does not name."""
    documents = table(spark, folder, "documents")
    return unlabelled_languages(documents, fit_on(documents))


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of each document."""
    documents = table(spark, folder, "documents")
    return document_languages(documents, fit_on(documents))


def p10_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of each document in one language."""
    documents = table(spark, folder, "documents")
    return language_stretches(documents, fit_on(documents))


QUERIES = {f.__name__: f for f in (p2_found, p2_clusters, p3_found, p3_survivors, p4_found, p4_pieces, p7_found, p8_containers, p8_summary, p9_found, p9_leaks, p10_found, p10_languages, p10_stretches)}

ORACLE = {
    "p3_found": r"""
WITH said AS (
  SELECT DISTINCT ON (resolution_id) resolution_id, computed_at, source_id, measure, period_key, lower(trim(regexp_replace(entity, '\s+', ' ', 'g'))) AS e,
         len(list_filter(coalesce(fact_ids, []), lambda x: x IS NOT NULL AND trim(x) <> '')) > 0 AS f,
         lower(trim(coalesce(conflict_id, ''))) NOT IN ('', '-', 'n/a', 'none', 'null') AS c,
         coalesce(decision.conflict_id, decision.outcome, decision.winning_fact_id, decision.decided_by, decision.reason, decision.rule_fired, decision.resolved_at::VARCHAR) IS NOT NULL AS d,
         lower(trim(coalesce(state, ''))) NOT IN ('', 'n/a', 'null', 'unknown') AS s
  FROM ledger_resolutions)
SELECT min(resolution_id) AS group_id,
       coalesce(max_by(resolution_id, computed_at) FILTER (f), 0) AS fact_ids_from,
       coalesce(max_by(resolution_id, computed_at) FILTER (c), 0) AS conflict_id_from,
       coalesce(max_by(resolution_id, computed_at) FILTER (d), 0) AS decision_from,
       coalesce(max_by(resolution_id, computed_at) FILTER (s), 0) AS state_from
FROM said GROUP BY source_id, measure, period_key, e HAVING count(DISTINCT resolution_id) > 1
""",
    "p4_found": r"""
SELECT DISTINCT document_version_id, paragraph_index FROM docx_paragraphs
WHERE length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760)
  || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288))) > 1200
""",
}
