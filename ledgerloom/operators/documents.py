"""Documents, their versions and copies, and what happens to the ledger when some are withdrawn or removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import require

FINGERPRINT_BUCKETS = 4096


def content_hash(c: Column) -> Column:
    """SHA-256 of a content, in hexadecimal digits."""
    return F.sha2(c, 256)


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """Documents of one content within a tenant: tenant_id, sha256, kept_id, n_copies.

    The one ingested first is kept (ties: the smaller id).  Null texts are compared by nothing and left out.
    """
    require(documents, "doc_id", "tenant_id", "text", "ingested_at")
    hashed = documents.where("text IS NOT NULL").select("tenant_id", "doc_id", "ingested_at", content_hash(F.col("text")).alias("sha256"))
    return hashed.groupBy("tenant_id", "sha256").agg(F.min(F.struct("ingested_at", "doc_id")).alias("_first"), F.count("*").alias("n_copies")).select("tenant_id", "sha256", F.col("_first.doc_id").alias("kept_id"), "n_copies")


def number_versions(versions: DataFrame) -> DataFrame:
    """Adds version_number (1, 2, ... by creation, then id) and is_current (the last of its document)."""
    require(versions, "document_id", "document_version_id", "created_at")
    w = Window.partitionBy("document_id").orderBy("created_at", "document_version_id")
    last = Window.partitionBy("document_id")
    numbered = versions.withColumn("version_number", F.row_number().over(w))
    return numbered.withColumn("is_current", F.col("version_number") == F.max("version_number").over(last))


def prune_conflicts(conflicts: DataFrame, removed_facts: DataFrame) -> DataFrame:
    """Conflicts without the facts that are removed: conflict_id, fact_ids, status, outcome, pruned.

    An open conflict left with fewer than two facts is resolved as superseded.  The removed facts are joined to the exploded
    members, so that no list of them ever travels whole.
    """
    require(conflicts, "conflict_id", "fact_ids", "status")
    members = conflicts.select("conflict_id", "status", "outcome", F.posexplode_outer("fact_ids").alias("_at", "fact_id"))
    marked = members.join(removed_facts.select("fact_id").distinct().withColumn("_gone", F.lit(True)), "fact_id", "left")
    kept = marked.groupBy("conflict_id", "status", "outcome").agg(
        F.array_sort(F.collect_list(F.when(F.col("_gone").isNull(), F.struct("_at", "fact_id")))).alias("_kept"), F.count_if(F.col("_gone")).alias("pruned"),
    )
    ids = F.filter(F.transform("_kept", lambda k: k["fact_id"]), lambda f: f.isNotNull())
    closes = (F.col("status") == "open") & (F.col("pruned") > 0) & (F.size(ids) < 2)
    return kept.select("conflict_id", ids.alias("fact_ids"), F.when(closes, "resolved").otherwise(F.col("status")).alias("status"), F.when(closes, "superseded").otherwise(F.col("outcome")).alias("outcome"), "pruned")


def within_budget(items: DataFrame, series: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """The first items of each series, in order, up to (not including) the first that would exceed the budget.

    Adds ``running``.  A null cost is 0.  ``order`` must be unique within the series.
    """
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = items.withColumn("running", F.sum(F.coalesce(F.col(cost), F.lit(0))).over(w))
    return walked.withColumn("_over", F.max((F.col("running") > budget).cast("int")).over(w)).where("_over = 0").drop("_over")


def in_batches(items: DataFrame, series: list[str], order: list[str], size: int) -> DataFrame:
    """Adds batch_no (from 0): consecutive groups of ``size`` items of a series."""
    return items.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(*series).orderBy(*order)) - 1) / size).cast("int"))


def corpus_fingerprint(ids: DataFrame, column: str) -> DataFrame:
    """One digest of a set of ids, independent of their order and partitioning: fingerprint, n.

    Two levels (the digest of the sorted ids of each of FINGERPRINT_BUCKETS buckets, then of the sorted bucket digests), so
    that no task sees all ids.
    """
    distinct = ids.select(F.col(column).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    buckets = distinct.groupBy(F.pmod(F.xxhash64("id"), F.lit(FINGERPRINT_BUCKETS)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("digest"), F.count("*").alias("n"))
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(F.format_string("%04d:", "b"), "digest"))), "\n"), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def members_of(conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    """How many of a conflict's facts exist: conflict_id, n_members, n_found, complete."""
    listed = conflicts.select("conflict_id", F.explode_outer("fact_ids").alias("fact_id")).join(facts.select("fact_id").distinct().withColumn("_there", F.lit(True)), "fact_id", "left")
    sums = listed.groupBy("conflict_id").agg(F.count("fact_id").alias("n_members"), F.count_if("_there").alias("n_found"))
    return sums.withColumn("complete", F.col("n_members") == F.col("n_found"))


def most_concurrent(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The most intervals of each key that hold one instant, by a sweep line (an end comes before a start at one instant)."""
    edges = intervals.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.*")
    w = Window.partitionBy(key).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return edges.withColumn("_open", F.sum("d").over(w)).groupBy(key).agg(F.max("_open").alias("most"))


def sweep_withdrawals(listing: DataFrame, sweeps: DataFrame, absent_sweeps: int = 2, most_absent: float = 0.5) -> DataFrame:
    """Files withdrawn because consecutive sweeps did not list them: source_id, path, sweep_no (where it is withdrawn).

    ``listing``: source_id, sweep_no, path; ``sweeps``: source_id, sweep_no of all sweeps that took place.  A sweep is set
    aside, and no absence is counted in it, if it lists nothing while the sweep before it listed something, or lacks more
    than ``most_absent`` of what the sweep before it listed.  A file listed again starts anew.  Ranges of sweeps between two
    listings of a file replace a counter: no state is carried row by row.
    """
    order = Window.partitionBy("source_id").orderBy("sweep_no")
    numbered = sweeps.select("source_id", "sweep_no").distinct().withColumn("_next", F.lead("sweep_no").over(order))
    present = listing.select("source_id", "sweep_no", "path").distinct()
    expected = present.join(numbered.where("_next IS NOT NULL"), ["source_id", "sweep_no"]).select("source_id", F.col("_next").alias("sweep_no"), "path")
    missing = expected.join(present, ["source_id", "sweep_no", "path"], "left_anti").groupBy("source_id", "sweep_no").agg(F.count("*").alias("n_missing"))
    rates = expected.groupBy("source_id", "sweep_no").agg(F.count("*").alias("n_expected")).join(missing, ["source_id", "sweep_no"], "left")
    doubtful = rates.where(F.coalesce("n_missing", F.lit(0)) > most_absent * F.col("n_expected")).select("source_id", "sweep_no")
    counted = numbered.join(doubtful, ["source_id", "sweep_no"], "left_anti").select("source_id", "sweep_no").withColumn("_at", F.row_number().over(order))
    last = counted.groupBy("source_id").agg(F.max("_at").alias("_last"))
    seen = present.join(counted, ["source_id", "sweep_no"])
    per_file = Window.partitionBy("source_id", "path").orderBy("_at")
    gaps = seen.withColumn("_again", F.lead("_at").over(per_file)).join(last, "source_id")
    due = gaps.where(F.coalesce(F.col("_again") - 1, F.col("_last")) - F.col("_at") >= absent_sweeps).select("source_id", "path", (F.col("_at") + absent_sweeps).alias("_at"))
    return due.join(counted, ["source_id", "_at"]).select("source_id", "path", "sweep_no")


def measure_faults(measures: DataFrame) -> DataFrame:
    """Definitions that break a rule: slug, fault.

    Rules: a slug of small letters, digits and underscores; a label; exactly one unit of factor 1, the canonical one; positive
    finite factors; a tolerance of at least 0; no alias that another definition has too.
    """
    ones = F.filter("units", lambda u: u["to_canonical_factor"] == 1)
    faults = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("slug").rlike("^[a-z][a-z0-9_]{0,63}$"), F.lit(False)), "slug"),
        F.when(F.coalesce(F.trim("label"), F.lit("")) == "", "label"),
        F.when((F.size(ones) != 1) | (F.try_element_at(ones, F.lit(1))["id"] != F.col("canonical_unit")), "canonical-unit"),
        F.when(F.exists("units", lambda u: ~(F.coalesce(u["to_canonical_factor"], F.lit(-1.0)) > 0)), "factor"),
        F.when(~(F.coalesce(F.col("tolerance"), F.lit(-1.0)) >= 0), "tolerance"),
    ))
    own = measures.select("slug", F.explode(faults).alias("fault"))
    alias = measures.select("slug", F.explode("aliases").alias("a")).select("slug", F.lower(F.trim("a")).alias("a")).distinct()
    shared = alias.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    return own.unionByName(alias.join(shared, "a", "left_semi").select("slug", F.lit("alias-shared").alias("fault")).distinct())
