"""Lives of documents, versions, measures, conflicts and attempts: who stands, who is withdrawn, who came too late."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require
from ledgerloom.functions.text import measure_slug

#: A submission decodes to at most this many bytes.
LARGEST_SUBMISSION = 20 * 1024 * 1024
#: Facts that a proposed measure keeps as evidence.
EVIDENCE = 50

# Units and tolerance of a measure nobody has described, by its value type.
MEASURE_DEFAULTS = (
    ("percentage", "ratio", (("ratio", 1.0), ("percent", 0.01)), "absolute", 0.01),
    ("currency", "usd", (("usd", 1.0), ("usd_thousands", 1e3), ("usd_millions", 1e6)), "relative", 0.01),
    ("area", "sf", (("sf", 1.0), ("thousand_sf", 1e3)), "relative", 0.01),
    ("duration", "years", (("years", 1.0), ("months", 1 / 12)), "absolute", 0.0),
    ("count", "count", (("count", 1.0),), "absolute", 0.0),
)


def fact_lifecycle(facts: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """fact_id, withdrawn, superseded.  A fact whose version is missing has no life and is left out.

    ``facts``: fact_id, document_version_id.  ``versions``: document_version_id, document_id, withdrawn_at.  ``documents``:
    document_id, current_version_id.  Superseded means that the document has a current version, and it is another.
    """
    of = facts.select("fact_id", "document_version_id").join(versions.select("document_version_id", "document_id", "withdrawn_at"), "document_version_id")
    both = of.join(documents.select("document_id", "current_version_id"), "document_id", "left")
    return both.select("fact_id", F.col("withdrawn_at").isNotNull().alias("withdrawn"), F.coalesce(F.col("current_version_id") != F.col("document_version_id"), F.lit(False)).alias("superseded"))


def live_hits(hits: DataFrame, versions: DataFrame) -> DataFrame:
    """Hits whose version is known and not withdrawn, with its document.  Use refuse_missing first where an unknown version
    is an error.
    """
    require(hits, "document_version_id")
    standing = versions.where("withdrawn_at IS NULL").select("document_version_id", F.col("document_id").alias("of_document"))
    return hits.join(standing, "document_version_id")


def withdrawn_citations(answers: DataFrame, versions: DataFrame) -> DataFrame:
    """answer_id, and the withdrawn versions that an answer cites (sorted, an empty array if none).

    ``answers``: answer_id, document_version_id, one row per citation.
    """
    gone = versions.where("withdrawn_at IS NOT NULL").select("document_version_id").withColumn("_gone", F.lit(True))
    cited = answers.select("answer_id", "document_version_id").distinct().join(gone, "document_version_id", "left")
    return cited.groupBy("answer_id").agg(F.array_sort(F.collect_set(F.when(F.col("_gone"), F.col("document_version_id")))).alias("withdrawn_versions"))


def add_version(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """What an upload of other content to a path does: document_id, path, source_id, action, n_locations.

    ``documents``: document_id, locations array<struct<path, source_id>>.  ``uploads``: document_id, path, source_id.  A
    document found in one place gets a new version; one found in several forgets the place, which gets a document of its
    own (fork).  n_locations is what the document is left with.
    """
    joined = uploads.join(documents.select("document_id", "locations"), "document_id")
    rest = F.filter("locations", lambda x: ~((x["path"] == F.col("path")) & x["source_id"].eqNullSafe(F.col("source_id"))))
    several = F.size("locations") > 1
    return joined.select("document_id", "path", "source_id", F.when(several, "fork").otherwise("version").alias("action"), F.when(several, F.size(rest)).otherwise(F.size("locations")).alias("n_locations"))


def apply_source_class(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their source's class in place of another one; facts of unknown or unclassified sources keep theirs."""
    of = sources.where("source_class IS NOT NULL").groupBy("source_id").agg(F.max("source_class").alias("_registered"))
    drifted = ~F.col("source_class").eqNullSafe(F.col("_registered")) & F.col("_registered").isNotNull()
    return facts.join(of, "source_id", "left").withColumn("drifted", drifted).withColumn("source_class", F.coalesce("_registered", "source_class")).drop("_registered")


def propose_measures(unknown: DataFrame) -> DataFrame:
    """Measures proposed from names nobody knows: slug, label (the most used name), n_facts, evidence (fact ids).

    ``unknown``: fact_id, metric, created_at.  Names with one slug are one proposal; names without slug propose nothing.  At
    most EVIDENCE facts, the oldest, are kept as evidence: all count.
    """
    named = unknown.withColumn("slug", measure_slug(F.col("metric"))).where("slug IS NOT NULL")
    labels = named.groupBy("slug", F.trim("metric").alias("label")).agg(F.count("*").alias("n"))
    best = labels.groupBy("slug").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.sum("n").alias("n_facts"))
    oldest = Window.partitionBy("slug").orderBy("created_at", "fact_id")
    kept = named.withColumn("_n", F.row_number().over(oldest)).where(F.col("_n") <= EVIDENCE).groupBy("slug").agg(F.array_sort(F.collect_list("fact_id")).alias("evidence"))
    return best.join(kept, "slug")


def decide_measures(measures: DataFrame, decisions: DataFrame) -> DataFrame:
    """Measures after decisions: slug, status, measure_version, rescan.

    ``decisions``: slug, decision (confirm, reject, update).  Confirming and updating raise the version and ask for a scan of
    the measure's cells; rejecting does neither.  Of several decisions the first by name counts.
    """
    one = decisions.groupBy("slug").agg(F.min("decision").alias("_d"))
    d = F.col("_d")
    touched = F.coalesce(d.isin("confirm", "update"), F.lit(False))
    return measures.join(one, "slug", "left").select("slug", F.when(d == "confirm", "confirmed").when(d == "reject", "rejected").otherwise(F.col("status")).alias("status"), (F.col("measure_version") + touched.cast("int")).alias("measure_version"), touched.alias("rescan"))


def measure_defaults(measures: DataFrame) -> DataFrame:
    """Measures with the units and tolerance of their value type where they state none: slug, canonical_unit, n_units,
    tolerance_kind, tolerance.  Unknown value types stay as they are.
    """
    rows = [(kind, unit, [(i, float(f)) for i, f in units], how, tolerance) for kind, unit, units, how, tolerance in MEASURE_DEFAULTS]
    seeds = measures.sparkSession.createDataFrame(rows, "value_type string, _unit string, _units array<struct<id: string, to_canonical_factor: double>>, _how string, _tolerance double")
    joined = measures.join(seeds, "value_type", "left")
    return joined.select("slug", F.coalesce("canonical_unit", "_unit").alias("canonical_unit"), F.size(F.when(F.size("units") > 0, F.col("units")).otherwise(F.col("_units"))).alias("n_units"), F.coalesce("tolerance_kind", "_how").alias("tolerance_kind"), F.coalesce("tolerance", "_tolerance").alias("tolerance"))


def conflict_listing(members: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each conflict as a list shows it: conflict_id, n_values, n_withdrawn, stale, unscorable, proposed_fact_id.

    ``members``: conflict_id, tenant_id, group_key, fact_id, canonical, withdrawn, superseded; a member that is no fact has a null
    group_key.  ``proposals``: tenant_id, group_key, basis, fact_id.  Stale: a member was withdrawn or superseded since.
    Unscorable: 'too-few-members' (under two are facts), else 'no-common-unit' (a member's value cannot be converted).
    """
    out, old = F.coalesce(F.col("withdrawn"), F.lit(False)), F.coalesce(F.col("superseded"), F.lit(False))
    known = F.col("group_key").isNotNull()
    sums = members.groupBy("conflict_id").agg(
        F.count("canonical").alias("n_values"), F.count_if(out).alias("n_withdrawn"), F.bool_or(out | old).alias("stale"), F.count_if(known).alias("_n"), F.bool_or(known & F.col("canonical").isNull()).alias("_apart"),
        F.min(F.struct("tenant_id", "group_key")).alias("_cell"),
    )
    cell = sums.select("*", F.col("_cell.tenant_id").alias("tenant_id"), F.col("_cell.group_key").alias("group_key"))
    of = proposals.where("basis <> 'none'").select("tenant_id", "group_key", F.col("fact_id").alias("proposed_fact_id"))
    unscorable = F.when(F.col("_n") < 2, "too-few-members").when(F.col("_apart"), "no-common-unit")
    return cell.join(of, ["tenant_id", "group_key"], "left").select("conflict_id", "n_values", "n_withdrawn", "stale", unscorable.alias("unscorable"), "proposed_fact_id")


def record_resolutions(conflicts: DataFrame, rulings: DataFrame) -> DataFrame:
    """Rulings written into open conflicts: conflict_id, status, winning_fact_id, followed_proposal (null without proposal).

    ``conflicts``: conflict_id, status, proposed_fact_id.  ``rulings``: conflict_id, winning_fact_id.  Closed conflicts stay.
    """
    ruled = (F.col("status") == "open") & F.col("winning_fact_id").isNotNull()
    return conflicts.join(rulings.select("conflict_id", "winning_fact_id"), "conflict_id", "left").select(
        "conflict_id", F.when(ruled, "resolved").otherwise(F.col("status")).alias("status"), F.when(ruled, F.col("winning_fact_id")).alias("winning_fact_id"), F.when(ruled, F.col("winning_fact_id") == F.col("proposed_fact_id")).alias("followed_proposal")
    )


def submission_fault(content: Column) -> Column:
    """Why a base64 text is refused: 'too-large' (before it is decoded), 'not-base64', 'empty'; null if it is fine."""
    size = F.length(content)
    return (
        F.when(content.isNull(), "empty").when(size > (LARGEST_SUBMISSION + 2) / 3 * 4, "too-large")
        .when((size % 4 != 0) | ~content.rlike(r"^[A-Za-z0-9+/]*={0,2}\z"), "not-base64").when(size == 0, "empty")
    )


def submitted(submissions: DataFrame) -> DataFrame:
    """Inline submissions, decoded: submission_id, fault, n_bytes, sha256 (of what is accepted).

    ``submissions``: submission_id, content_base64.
    """
    checked = submissions.withColumn("fault", submission_fault(F.col("content_base64")))
    body = F.unbase64(F.when(F.col("fault").isNull(), F.col("content_base64")))
    return checked.select("submission_id", "fault", F.octet_length(body).alias("n_bytes"), F.sha2(body, 256).alias("sha256"))


def fenced_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts at a job that may write their result: all columns of ``attempts``, and accepted.

    ``attempts``: job, token (the lease, growing), started_at, finished_at.  An attempt is fenced off if one with a later
    token had started before it finished.  One aggregation over the job's tokens, no comparison of all with all: what counts
    is the earliest start among the later tokens, a running minimum.
    """
    later = Window.partitionBy("job").orderBy(F.col("token").desc()).rowsBetween(Window.unboundedPreceding, -1)
    overtaken = F.min("started_at").over(later) < F.col("finished_at")
    return attempts.withColumn("accepted", ~F.coalesce(overtaken, F.lit(False)))


def gate_outcomes(requests: DataFrame, answers: DataFrame, hours: int = 24) -> DataFrame:
    """What became of requests to a person: request_id, outcome (that person's, or timed_out).

    ``requests``: request_id, opened_at.  ``answers``: request_id, answered_at, outcome.  The first answer within the time
    counts; later ones come too late, and the timeout is the outcome.  Works on streams as well, given watermarks on both
    times: the condition bounds the state.
    """
    a = answers.select(F.col("request_id").alias("_id"), "answered_at", "outcome")
    in_time = (F.col("request_id") == F.col("_id")) & (F.col("answered_at") >= F.col("opened_at")) & (F.col("answered_at") <= F.col("opened_at") + F.expr(f"INTERVAL {hours} HOURS"))
    joined = requests.join(a, in_time, "left")
    if joined.isStreaming:
        return joined.select("request_id", "opened_at", F.coalesce("outcome", F.lit("timed_out")).alias("outcome"))
    first = joined.groupBy("request_id").agg(F.min(F.struct("answered_at", "outcome")).alias("f"), F.count("answered_at").alias("n"))
    return first.select("request_id", F.when(F.col("n") > 0, F.col("f.outcome")).otherwise("timed_out").alias("outcome"))


def recorded_views(views: DataFrame, seconds: int) -> DataFrame:
    """Views that are recorded: per key the first, and then the first after each full window since the last recorded one.

    ``views``: key, ts, view_id.  Views at one instant count in order of their id.  The rows of a key pass in order through one
    task, which keeps a single time: nothing is gathered, however many rows a key has.
    """
    require(views, "key", "ts", "view_id")
    schema = T.StructType([views.schema["key"], views.schema["view_id"], views.schema["ts"]])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recorded = None, None
        for batch in batches:
            stays = []
            for key, micros in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.int64()).to_pylist(), strict=True):
                if key != current:
                    current, recorded = key, None
                stays.append(recorded is None or micros - recorded >= seconds * 1_000_000)
                recorded = micros if stays[-1] else recorded
            yield batch.filter(pa.array(stays, pa.bool_()))

    rows = views.where("key IS NOT NULL AND ts IS NOT NULL").select("key", "view_id", "ts").repartition("key").sortWithinPartitions("key", "ts", "view_id")
    return rows.mapInArrow(keep, schema).select("key", "view_id")
