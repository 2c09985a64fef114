"""Queries of listings, lives of documents and measures, and figures, over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import table
from ledgerloom.functions.text import entity_fold
from ledgerloom.operators import figures, lifecycle, listing, locators
from ledgerloom.operators.ledger import measure_aliases, propose_survivor, stored_conflicts
from ledgerloom.plans.ledger_queries import _kept_facts
from ledgerloom.plans.sql_parts import LEDGER_FACTS, STORED, fold


def sources_selected(spark: SparkSession, folder: str) -> DataFrame:
    """A projection by name: the key, two known columns, one nobody knows."""
    return listing.pick_fields(table(spark, folder, "sources"), "source_name, kind,nope", "source_id")


def sources_declared(spark: SparkSession, folder: str) -> DataFrame:
    """Only declared columns leave."""
    return listing.whitelisted(table(spark, folder, "sources"), ("source_id", "kind", "enabled", "file_count"))


def documents_without_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without their large column."""
    return listing.without(table(spark, folder, "documents"), "text", "embedding").select("doc_id", "lang", "source", "title", "source_kind", "source_class", "tenant_id")


def facts_of_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per tenant that stand in a stored conflict."""
    ids = stored_conflicts(table(spark, folder, "conflicts")).select(F.explode("fact_ids").alias("fact_id"))
    return listing.with_ids(table(spark, folder, "facts").select("tenant_id", "fact_id").distinct(), "fact_id", ids).groupBy("tenant_id").agg(F.count("*").alias("n"))


def facts_by_methods(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of two extraction methods, by a short list."""
    return listing.with_ids(table(spark, folder, "facts"), "extraction_method", ["llm", "manual"]).groupBy("extraction_method").agg(F.countDistinct("fact_id").alias("n"))


def cells_under_entity(spark: SparkSession, folder: str) -> DataFrame:
    """Cells whose key begins with the last entity of the resolutions, by letter order."""
    first = table(spark, folder, "ledger_resolutions").agg(F.max(entity_fold(F.col("entity"))).alias("e"))
    cells = _kept_facts(spark, folder).where("group_key IS NOT NULL").select("tenant_id", "group_key").distinct()
    return cells.crossJoin(F.broadcast(first)).where(listing.under_entity(F.col("group_key"), F.col("e"))).select("tenant_id", "group_key")


def _located(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "file_states").where("document_id IS NOT NULL").select("document_id", "path", "source_id").distinct()
    return f.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("path", "source_id"))).alias("locations"))


def documents_elsewhere(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not found at the first path of the first source, with how many places they have."""
    at = table(spark, folder, "file_states").where("document_id IS NOT NULL").agg(F.min(F.struct("source_id", "path")).alias("p"))
    return _located(spark, folder).crossJoin(F.broadcast(at)).where(~listing.has_location(F.col("locations"), F.col("p.path"), F.col("p.source_id"))).select("document_id", F.size("locations").alias("n"))


def spend_within_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    """Users who may spend 50 more under a ceiling of 900: purchases are spent, signups reserved."""
    e = table(spark, folder, "events")
    sums = e.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("spent"), F.sum(F.when(F.col("event_type") == "signup", F.col("value"))).alias("reserved"))
    return sums.where(listing.within_ceiling(F.col("spent"), F.col("reserved"), F.lit(50.0), F.lit(900.0))).select("user_id", F.round("spent", 4).alias("spent"), F.round("reserved", 4).alias("reserved"))


def confirmed_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of confirmed measures, per measure."""
    ok = table(spark, folder, "measure_defs").where("status = 'confirmed'").select(F.col("slug").alias("metric_slug"))
    return _kept_facts(spark, folder).join(ok, "metric_slug", "left_semi").groupBy("metric_slug").agg(F.count("*").alias("n"))


def sources_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten sources by name from the end."""
    s = table(spark, folder, "sources").select("source_id", "source_name", "kind")
    return listing.sorted_by(s, "source_name", "desc", ("source_name", "kind"), "source_id", "source_id").limit(10)


def paragraph_order(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs in the order of their locators, per version."""
    p = table(spark, folder, "docx_paragraphs").select("document_version_id", "paragraph_index").distinct()
    key = listing.locator_order(F.lit("docx-paragraph"), F.col("paragraph_index"), F.lit(None).cast("string"))
    return p.withColumn("sort_key", key).withColumn("place", F.row_number().over(Window.partitionBy("document_version_id").orderBy("sort_key")))


def conflict_members_appended(spark: SparkSession, folder: str) -> DataFrame:
    """Members of stored conflicts, the winner appended where it is none of them."""
    c = stored_conflicts(table(spark, folder, "conflicts"))
    return c.select("conflict_id", F.size(listing.appended(F.col("fact_ids"), F.col("winning_fact_id"))).alias("n"))


def metric_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of known measures and of names nobody knows, in one frame."""
    f = _kept_facts(spark, folder)
    known = f.where("metric_slug IS NOT NULL").select("fact_id", "metric_slug")
    return listing.candidates_of(known, f.where("metric_slug IS NULL").select("fact_id")).groupBy("origin").agg(F.count("*").alias("n"), F.count("metric_slug").alias("n_slugs"))


def unknown_members(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of facts that no delivery lists, and facts no resolution names: ids without a row, counted."""
    f, r = table(spark, folder, "facts"), table(spark, folder, "ledger_resolutions")
    a = listing.missing_ids(f, table(spark, folder, "file_states"), "document_id").agg(F.lit("documents").alias("kind"), F.count("*").alias("n"))
    return a.unionByName(listing.missing_ids(f, r.select(F.explode("fact_ids").alias("fact_id")), "fact_id").agg(F.lit("facts").alias("kind"), F.count("*").alias("n")))


def flattened_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Tenants as answers, their conflicts as claims, the members as citations: flattened, citations per answer."""
    c = stored_conflicts(table(spark, folder, "conflicts")).groupBy(F.col("tenant_id").alias("answer_id")).agg(F.collect_list(F.struct(F.col("conflict_id").alias("claim_id"), F.col("fact_ids").alias("citations"))).alias("claims"))
    return listing.flattened(c).groupBy("answer_id").agg(F.count("*").alias("n_citations"), F.countDistinct("claim_id").alias("n_claims"), F.countDistinct("citation").alias("n_facts"))


def flat_metric_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Nested counts of the documents as dotted metrics; one of them is no number, one part is left out."""
    d = table(spark, folder, "documents")
    nested = d.agg(F.struct(F.count("*").alias("n"), F.struct(F.count("title").alias("titled"), F.count("lang").alias("labelled"), F.lit(float("nan")).alias("nothing")).alias("parts"), F.struct(F.count("*").alias("n")).alias("hidden")).alias("documents"))
    return listing.flat_metrics(nested, ("documents.hidden.",))


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Versions seen in the paragraphs, with the withdrawal of their document; and each document's current version."""
    gone = table(spark, folder, "file_states").groupBy("document_id").agg(F.max("withdrawn_at").alias("withdrawn_at"))
    v = table(spark, folder, "docx_paragraphs").select("document_version_id", "document_id").distinct().join(gone, "document_id", "left")
    return v, v.groupBy("document_id").agg(F.max("document_version_id").alias("current_version_id"))


def fact_lives(spark: SparkSession, folder: str) -> DataFrame:
    """Facts by withdrawn and superseded, joined from versions and documents; facts of unknown versions have no life."""
    v, d = _versions(spark, folder)
    return lifecycle.fact_lifecycle(table(spark, folder, "facts").select("fact_id", "document_version_id").distinct(), v, d).groupBy("withdrawn", "superseded").agg(F.count("*").alias("n"))


def live_fact_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Facts taken as hits whose version stands, per document."""
    hits = table(spark, folder, "facts").select("fact_id", "document_version_id").distinct()
    return lifecycle.live_hits(hits, _versions(spark, folder)[0]).groupBy("of_document").agg(F.count("*").alias("n"))


def standing_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose current version is not withdrawn."""
    v, d = _versions(spark, folder)
    ok = v.where("withdrawn_at IS NULL").select(F.col("document_version_id").alias("current_version_id"))
    return d.join(ok, "current_version_id", "left_semi").select("document_id", "current_version_id")


def withdrawn_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Withdrawn versions that resolutions rest on, for those that rest on any."""
    v = _versions(spark, folder)[0]
    f = table(spark, folder, "facts").select("fact_id", "document_version_id").distinct()
    r = table(spark, folder, "ledger_resolutions").select(F.col("resolution_id").alias("answer_id"), F.explode("fact_ids").alias("fact_id")).distinct().join(f, "fact_id")
    return lifecycle.withdrawn_citations(r, v).where(F.size("withdrawn_versions") > 0).select("answer_id", F.array_join(F.transform("withdrawn_versions", lambda x: x.cast("string")), ",").alias("withdrawn_versions"))


def version_or_fork(spark: SparkSession, folder: str) -> DataFrame:
    """What new content at each place of a document does: a version, or a document of its own."""
    places = table(spark, folder, "file_states").where("document_id IS NOT NULL").select("document_id", "path", "source_id").distinct()
    return lifecycle.add_version(_located(spark, folder), places).groupBy("action", "n_locations").agg(F.count("*").alias("n"))


def classes_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per class after their sources' classes were applied, and how many changed."""
    f = table(spark, folder, "facts").select("fact_id", "source_id", "source_class").distinct()
    return lifecycle.apply_source_class(f, table(spark, folder, "sources")).groupBy("source_class").agg(F.count("*").alias("n"), F.count_if("drifted").alias("n_changed"))


def measure_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Measures that names nobody knows propose."""
    f = table(spark, folder, "facts").select("fact_id", "metric", "created_at", F.lower(F.trim("metric")).alias("alias")).distinct()
    unknown = f.join(measure_aliases(table(spark, folder, "measure_defs")), "alias", "left_anti")
    return lifecycle.propose_measures(unknown).select("slug", "n_facts", F.size("evidence").alias("n_evidence"), F.element_at("evidence", 1).alias("first_evidence"))


def measures_decided(spark: SparkSession, folder: str) -> DataFrame:
    """Measures after headers were confirmed, manual ones rejected, and seeds left alone."""
    m = table(spark, folder, "measure_defs")
    decided = m.where("origin <> 'seed'").select("slug", F.when(F.col("origin") == "header", "confirm").otherwise("reject").alias("decision"))
    return lifecycle.decide_measures(m, decided)


def measures_with_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Measures, their units and tolerances withheld from all that are no seeds, by the defaults of their value type."""
    seed = F.col("origin") == "seed"
    m = table(spark, folder, "measure_defs")
    return lifecycle.measure_defaults(m.select("slug", "value_type", *[F.when(seed, F.col(c)).alias(c) for c in ("canonical_unit", "units", "tolerance_kind", "tolerance")]))


def _members(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    c = stored_conflicts(table(spark, folder, "conflicts")).select("conflict_id", F.explode("fact_ids").alias("fact_id"))
    return c.join(facts.select("fact_id", "tenant_id", "group_key", "canonical", "withdrawn", "superseded"), "fact_id", "left")


def _proposals(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    return propose_survivor(facts, table(spark, folder, "measure_defs"))


def conflict_list(spark: SparkSession, folder: str) -> DataFrame:
    """Stored conflicts as a list shows them."""
    f = _kept_facts(spark, folder)
    return lifecycle.conflict_listing(_members(spark, folder, f), _proposals(spark, folder, f))


def rulings_recorded(spark: SparkSession, folder: str) -> DataFrame:
    """Open conflicts ruled for their first member, and whether that follows the proposal."""
    stored = stored_conflicts(table(spark, folder, "conflicts"))
    rulings = stored.where("size(fact_ids) > 0").select("conflict_id", F.element_at("fact_ids", 1).alias("winning_fact_id"))
    listed = conflict_list(spark, folder).select("conflict_id", "proposed_fact_id")
    return lifecycle.record_resolutions(stored.select("conflict_id", "status").join(listed, "conflict_id", "left"), rulings).groupBy("status", "followed_proposal").agg(F.count("*").alias("n"), F.count("winning_fact_id").alias("n_ruled"))


def inline_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents submitted as base64, some cut, some with a stray character, some empty."""
    d = table(spark, folder, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("b"))
    b = F.col("b")
    spoiled = F.when(F.col("doc_id") % 50 == 1, F.expr("left(b, length(b) - 1)")).when(F.col("doc_id") % 50 == 2, F.overlay(b, F.lit("*"), F.lit(2))).when(F.col("doc_id") % 50 == 3, F.lit("")).otherwise(b)
    return lifecycle.submitted(d.select(F.col("doc_id").alias("submission_id"), spoiled.alias("content_base64")))


def fenced_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of sweeps as attempts: those overtaken by a later one before they arrived may not write."""
    a = table(spark, folder, "source_sweeps").select(F.concat_ws("/", "source_id", "sweep_no").alias("job"), F.col("delivery_no").alias("token"), F.col("snapshot_at").alias("started_at"), F.col("delivered_at").alias("finished_at")).distinct()
    return lifecycle.fenced_attempts(a).select("job", "token", "accepted")


def gate_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Conflicts as requests to a person who has 24 hours."""
    c = stored_conflicts(table(spark, folder, "conflicts"))
    got = c.where("resolved_at IS NOT NULL").select(F.col("conflict_id").alias("request_id"), F.col("resolved_at").alias("answered_at"), "outcome")
    return lifecycle.gate_outcomes(c.select(F.col("conflict_id").alias("request_id"), F.col("created_at").alias("opened_at")), got).groupBy("outcome").agg(F.count("*").alias("n"))


def recorded_views(spark: SparkSession, folder: str) -> DataFrame:
    """Views that the audit keeps: one per user and type, and again after six hours."""
    e = table(spark, folder, "events").select(F.concat_ws("/", "user_id", "event_type").alias("key"), "ts", F.col("event_id").alias("view_id"))
    return lifecycle.recorded_views(e, 6 * 3600).groupBy("key").agg(F.count("*").alias("n"), F.min("view_id").alias("first"), F.max("view_id").alias("last"))


def hourly_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counters and a histogram of the events of each hour, by type."""
    e = table(spark, folder, "events")
    buckets = [F.count_if(F.col("value") <= bound).alias(f"le_{bound}") for bound in (10, 100, 1000)]
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), *buckets).select(F.col("w.start").alias("hour"), "event_type", "n", "le_10", "le_100", "le_1000")


def value_renderings(spark: SparkSession, folder: str) -> DataFrame:
    """How the amounts of resolutions may be written."""
    r = table(spark, folder, "ledger_resolutions").where("amount IS NOT NULL").select("resolution_id", "amount", "unit").distinct()
    return r.select("resolution_id", F.array_join(figures.value_variants(F.col("amount"), F.col("unit")), "|").alias("variants"))


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "measure_defs").select(F.col("slug").alias("measure"), "value_type", "label")
    r = table(spark, folder, "ledger_resolutions").where("amount IS NOT NULL").select("resolution_id", "source_id", "measure", "amount").distinct().join(m, "measure")
    return r.withColumn("forms", figures.rendered_forms(F.col("amount"), F.col("value_type")))


def filing_renderings(spark: SparkSession, folder: str) -> DataFrame:
    """How a filing may write the amounts of resolutions."""
    return _forms(spark, folder).select("resolution_id", F.array_join(F.transform("forms", lambda f: F.concat_ws("x", f["text"], f["scale"].cast("string"))), "|").alias("forms"))


def located_values(spark: SparkSession, folder: str) -> DataFrame:
    """Where the values of resolutions stand among the quotes of their source."""
    v = _forms(spark, folder).select(F.col("resolution_id").alias("value_id"), F.col("source_id").alias("file"), "forms", F.filter(F.split(F.lower("label"), " "), lambda w: F.length(w) > 3).alias("labels"))
    e = table(spark, folder, "facts").where("raw_text IS NOT NULL").groupBy(F.col("source_id").alias("file"), F.col("fact_id").alias("element_id")).agg(F.max("raw_text").alias("text")).withColumn("label", F.col("text"))
    return figures.locate_values(v, e)


def corpus_sizing(spark: SparkSession, folder: str) -> DataFrame:
    """What reading all documents twice would cost, by kind and class."""
    d = table(spark, folder, "documents").select(F.coalesce("source_kind", F.lit("none")).alias("form"), F.coalesce("source_class", F.lit("none")).alias("role"), F.col("doc_id").alias("document_id"), F.ceil(F.length("text") / 2000).alias("n_chunks"), F.ceil(F.length("text") / 4).alias("n_tokens"))
    s = figures.corpus_sizing(d, 2, 1500, 300, 3.0, 15.0, 10.0, 4)
    return s.select("form", "role", "n_documents", *[F.round(c, 6).alias(c) for c in ("mean_chunks", "mean_tokens", "cost", "hours")])


def _fact_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts as claims: without measure nothing was retrieved, without value they are not grounded, in a stored conflict conflicting."""
    f = _kept_facts(spark, folder)
    c = stored_conflicts(table(spark, folder, "conflicts")).select(F.explode("fact_ids").alias("fact_id")).distinct().withColumn("_c", F.lit(True))
    v = F.when(F.col("metric_slug").isNull(), "no_evidence_retrieved").when(F.col("_c"), "conflicting_evidence").when(F.col("canonical").isNull(), "not_grounded").otherwise("grounded")
    return f.join(c, "fact_id", "left").select("fact_id", "source_id", "unit", v.alias("verdict"))


def verdict_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts per source and the share that failed."""
    bad = F.count_if(F.col("verdict").isin("not_grounded", "no_evidence_retrieved"))
    return _fact_verdicts(spark, folder).groupBy("source_id").agg(*[F.count_if(F.col("verdict") == k).alias(k) for k in ("grounded", "conflicting_evidence", "not_grounded", "no_evidence_retrieved")], F.round(bad / F.count("*"), 6).alias("failure_rate"))


def experiment_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The same as an experiment; ungrounded facts are its sample, caught rightly where no unit was written."""
    v = _fact_verdicts(spark, folder)
    reviews = v.where("verdict = 'not_grounded'").select(F.col("fact_id").alias("claim_id"), F.when(F.coalesce("unit", F.lit("")).isin("", "n/a", "tbd"), "correct_catch").otherwise("false_catch").alias("review"))
    s = figures.experiment_summary(v.select(F.col("fact_id").alias("claim_id"), "verdict"), reviews)
    return s.withColumn("failure_rate", F.round("failure_rate", 6)).withColumn("catch_rate", F.round("catch_rate", 6))


def joined_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation items as claims; verdicts come for two of three, some twice, some for numbers outside."""
    e = table(spark, folder, "eval_items")
    some = e.where("item_id % 3 > 0").select(F.col("item_id").alias("claim_no"), F.col("category").alias("verdict"))
    more = e.where("item_id % 10 = 1").select(F.col("item_id").alias("claim_no"), F.lit("answerable").alias("verdict")).unionByName(e.where("item_id % 40 = 0").select((-F.col("item_id") - 1).alias("claim_no"), F.lit("answerable").alias("verdict")))
    return figures.joined_verdicts(e.select(F.col("item_id").alias("claim_no"), F.col("case_id").alias("claim_id")), some.unionByName(more)).groupBy("verdict", "fault").agg(F.count("*").alias("n"))


def adjudication_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty evaluation items for review, by seed."""
    return figures.adjudication_sample(table(spark, folder, "eval_items").select("case_id", "category"), "case_id", 7)


def _paragraph_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of four paragraphs; those of uneven versions come without the record of their elements."""
    p = table(spark, folder, "docx_paragraphs").groupBy("document_version_id", "paragraph_index").agg(F.max("text").alias("text"))
    one = F.struct(F.col("paragraph_index").alias("index"), F.col("text").alias("text"))
    c = p.groupBy(F.col("document_version_id").alias("file"), F.floor(F.col("paragraph_index") / 4).alias("w")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return c.select(
        F.concat_ws("/", "file", "w").alias("chunk_id"), "file", F.lit("docx-paragraph").alias("kind"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("address"),
        F.when(F.col("file") % 2 == 0, F.col("all")).alias("elements"), F.array_join(F.transform("all", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"),
    )


def _paragraph_cases(spark: SparkSession, folder: str) -> DataFrame:
    """What a case per heading expects: the paragraph after it."""
    p = table(spark, folder, "docx_paragraphs").groupBy("document_version_id", "paragraph_index").agg(F.max("text").alias("text"), F.max("style").alias("style"))
    h = p.where("style LIKE 'Heading%'").select(F.col("document_version_id").alias("file"), (F.col("paragraph_index") + 1).alias("index"))
    after = p.select(F.col("document_version_id").alias("file"), F.col("paragraph_index").alias("index"), "text")
    return h.join(after, ["file", "index"]).select(F.concat_ws("/", "file", "index").alias("case_id"), "file", F.lit("docx-paragraph").alias("kind"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("address"), "index", "text")


def locator_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of paragraphs that overlap what each heading's case expects."""
    return locators.expected_overlaps(_paragraph_chunks(spark, folder), _paragraph_cases(spark, folder))


def _conflict_chunks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Chunks that hold the values of stored conflicts (their documents), and those their resolutions rest on."""
    f = table(spark, folder, "facts").select("fact_id", F.col("document_id").alias("chunk_id")).distinct()
    values = stored_conflicts(table(spark, folder, "conflicts")).select(F.col("conflict_id").alias("case_id"), F.explode_outer("fact_ids").alias("fact_id")).join(f, "fact_id", "left").select("case_id", "chunk_id").distinct()
    r = table(spark, folder, "ledger_resolutions").where("conflict_id IS NOT NULL").select(F.col("conflict_id").alias("case_id"), F.explode("fact_ids").alias("fact_id")).join(f, "fact_id").select("case_id", "chunk_id").distinct()
    return values, r


def conflict_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every value of a conflict lies where its resolutions look."""
    return locators.scope_checks(*_conflict_chunks(spark, folder))


def citation_precision(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the conflicts' chunks that their resolutions rest on."""
    p = locators.citation_precision(*_conflict_chunks(spark, folder))
    return p.select("n_citations", F.round("precision", 6).alias("precision"))


def citation_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """The element of a chunk that holds the expected text, if it is just one."""
    c = locators.expected_overlaps(_paragraph_chunks(spark, folder).where("elements IS NOT NULL"), _paragraph_cases(spark, folder))
    j = c.join(_paragraph_chunks(spark, folder).select("chunk_id", "elements"), "chunk_id").join(_paragraph_cases(spark, folder).select("case_id", "text"), "case_id")
    return j.select("case_id", "chunk_id", locators.citation_index(F.col("elements"), F.col("text")).alias("paragraph_index"))


QUERIES = {f.__name__: f for f in (sources_selected, sources_declared, documents_without_text, facts_of_conflicts, facts_by_methods, cells_under_entity, documents_elsewhere, spend_within_ceiling, confirmed_facts, sources_sorted, paragraph_order, conflict_members_appended, metric_candidates, unknown_members, flattened_citations, flat_metric_rows, fact_lives, live_fact_hits, standing_documents, withdrawn_citations, version_or_fork, classes_applied, measure_proposals, measures_decided, measures_with_defaults, conflict_list, rulings_recorded, inline_submissions, fenced_deliveries, gate_outcomes, recorded_views, hourly_counters, value_renderings, filing_renderings, located_values, corpus_sizing, verdict_breakdown, experiment_summary, joined_verdicts, adjudication_sample, locator_overlaps, conflict_scope, citation_precision, citation_indexes)}

_VERSIONS = """
gone AS (SELECT document_id, max(withdrawn_at) AS withdrawn_at FROM file_states GROUP BY 1),
v AS (SELECT document_version_id, document_id, withdrawn_at FROM (SELECT DISTINCT document_version_id, document_id FROM docx_paragraphs) LEFT JOIN gone USING (document_id)),
d AS (SELECT document_id, max(document_version_id) AS current_version_id FROM v GROUP BY 1),
f AS (SELECT DISTINCT fact_id, document_version_id FROM facts)
"""
_PLACES = "places AS (SELECT DISTINCT document_id, path, source_id FROM file_states WHERE document_id IS NOT NULL)"
_PROPOSED = f"""
pf AS (SELECT l.*, m.authority_order, m.staleness_window_ms, nullif(coalesce(list_position(m.authority_order, l.source_class), 0), 0) AS rnk FROM lf l JOIN measure_defs m ON m.slug = l.metric_slug),
po AS (SELECT *, coalesce((rnk = min(rnk) OVER (PARTITION BY tenant_id, group_key))::INT, 0) AS top FROM pf),
pn AS (SELECT *, row_number() OVER w AS rn, lead(observed_on) OVER w AS nxt FROM po WINDOW w AS (PARTITION BY tenant_id, group_key ORDER BY top DESC, observed_on DESC NULLS LAST, created_at DESC, fact_id)),
pc AS (SELECT tenant_id, group_key, count(*) AS n, any_value(authority_order) AS ao, any_value(staleness_window_ms) AS win, bool_or(coalesce(source_class, 'unclassified') = 'unclassified') AS unc, bool_or(rnk IS NULL) AS outside,
  sum(top) AS n_top, bool_or(top = 1 AND observed_on IS NULL) AS unob, max(fact_id) FILTER (rn = 1) AS first_id, max(observed_on - nxt) FILTER (rn = 1) AS gap FROM pn GROUP BY 1, 2),
proposed AS (SELECT tenant_id, group_key, first_id FROM pc WHERE n >= 2 AND ao IS NOT NULL AND len(ao) > 0 AND len(ao) = len(list_distinct(ao)) AND NOT unc AND NOT outside AND (n_top = 1 OR (NOT unob AND win IS NOT NULL AND gap::DOUBLE * 86400000 > win)))
"""
_LISTED = f"""
WITH {LEDGER_FACTS}, {STORED}, {_PROPOSED},
mem AS (SELECT conflict_id, unnest(fact_ids) AS fact_id FROM sc),
j AS (SELECT m.conflict_id, l.* FROM mem m LEFT JOIN lf l USING (fact_id)),
s AS (SELECT conflict_id, count(canonical) AS n_values, count(*) FILTER (coalesce(withdrawn, false)) AS n_withdrawn, bool_or(coalesce(withdrawn, false) OR coalesce(superseded, false)) AS stale, count(group_key) FILTER (metric_slug IS NOT NULL AND entity_key IS NOT NULL) AS n0, count(group_key) AS n,
  bool_or(group_key IS NOT NULL AND canonical IS NULL) AS apart, min((tenant_id, group_key)) AS cell FROM j GROUP BY 1),
listed AS (SELECT conflict_id, n_values, n_withdrawn, stale, CASE WHEN n < 2 THEN 'too-few-members' WHEN apart THEN 'no-common-unit' END AS unscorable, first_id AS proposed_fact_id
  FROM s LEFT JOIN proposed p ON p.tenant_id = s.cell[1] AND p.group_key = s.cell[2])
"""
_GROUPED = "format('{{:,}}', trunc({0})::BIGINT) || regexp_extract(regexp_replace({0}::VARCHAR, '\\.0$', ''), '\\.\\d+$')"
_WHOLE = "CASE WHEN floor({0} + 0.5) < 0 THEN '(' || format('{{:,}}', abs(floor({0} + 0.5))::BIGINT) || ')' ELSE format('{{:,}}', abs(floor({0} + 0.5))::BIGINT) END"
_RENDERED = f"""
r AS (SELECT DISTINCT resolution_id, source_id, measure, amount FROM ledger_resolutions WHERE amount IS NOT NULL),
forms0 AS (SELECT r.*, m.value_type, m.label, unnest(CASE WHEN value_type = 'currency' THEN [1, 1000, 1000000] ELSE [1] END) AS scale FROM r JOIN measure_defs m ON m.slug = r.measure),
forms1 AS (SELECT *, {_WHOLE.format('(amount / scale)')} AS text FROM forms0),
forms AS (SELECT * FROM forms1 QUALIFY row_number() OVER (PARTITION BY resolution_id, measure, amount, text ORDER BY scale) = 1)
"""
_VERDICTS = f"""
WITH {LEDGER_FACTS}, {STORED}, cm AS (SELECT DISTINCT unnest(fact_ids) AS fact_id FROM sc),
v AS (SELECT l.fact_id, l.source_id, l.unit, CASE WHEN metric_slug IS NULL THEN 'no_evidence_retrieved' WHEN cm.fact_id IS NOT NULL THEN 'conflicting_evidence' WHEN canonical IS NULL THEN 'not_grounded' ELSE 'grounded' END AS verdict
  FROM lf l LEFT JOIN cm USING (fact_id))
"""
_Q = "trim(regexp_replace(translate({0}, '‘’‚‛“”„‟–—−', '''''''''\"\"\"\"---'), '[\\s\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'))"
_CHUNKS = f"""
WITH p AS (SELECT document_version_id AS file, paragraph_index AS i, max(text) AS text, max(style) AS style FROM docx_paragraphs GROUP BY 1, 2),
c AS (SELECT file, floor(i / 4)::BIGINT AS w, list(i ORDER BY i) AS indexes, list(text ORDER BY i) AS texts, string_agg(coalesce(text, ''), chr(10) ORDER BY i) AS text FROM p GROUP BY 1, 2),
e AS (SELECT h.file, h.i + 1 AS i, a.text FROM p h JOIN p a ON a.file = h.file AND a.i = h.i + 1 WHERE h.style LIKE 'Heading%'),
o AS (SELECT DISTINCT concat_ws('/', e.file, e.i) AS case_id, concat_ws('/', c.file, c.w) AS chunk_id, c.file, e.text AS wanted, c.indexes, c.texts FROM e JOIN c USING (file)
  WHERE CASE WHEN file % 2 = 0 THEN list_contains(c.indexes, e.i) ELSE {_Q.format('e.text')} <> '' AND contains({_Q.format('c.text')}, {_Q.format('e.text')}) END)
"""
_SCOPES = f"""
WITH {STORED}, f AS (SELECT DISTINCT fact_id, document_id AS chunk_id FROM facts),
vals AS (SELECT DISTINCT s.conflict_id AS case_id, f.chunk_id FROM (SELECT conflict_id, unnest(CASE WHEN len(fact_ids) > 0 THEN fact_ids ELSE [NULL] END) AS fact_id FROM sc) s LEFT JOIN f USING (fact_id)),
rests AS (SELECT DISTINCT r.conflict_id AS case_id, f.chunk_id FROM (SELECT conflict_id, unnest(fact_ids) AS fact_id FROM ledger_resolutions WHERE conflict_id IS NOT NULL) r JOIN f USING (fact_id)),
hits AS (SELECT v.case_id, v.chunk_id, r.case_id IS NOT NULL AS hit FROM vals v LEFT JOIN rests r ON r.case_id = v.case_id AND r.chunk_id = v.chunk_id)
"""

ORACLE = {
    "sources_selected": "SELECT source_id, source_name, kind FROM sources",
    "sources_declared": "SELECT source_id, kind, enabled, file_count FROM sources",
    "documents_without_text": "SELECT doc_id, lang, source, title, source_kind, source_class, tenant_id FROM documents",
    "facts_of_conflicts": f"WITH {STORED}, m AS (SELECT DISTINCT unnest(fact_ids) AS fact_id FROM sc) SELECT tenant_id, count(*) AS n FROM (SELECT DISTINCT tenant_id, fact_id FROM facts) JOIN m USING (fact_id) GROUP BY 1",
    "facts_by_methods": "SELECT extraction_method, count(DISTINCT fact_id) AS n FROM facts WHERE extraction_method IN ('llm', 'manual') GROUP BY 1",
    "cells_under_entity": f"WITH {LEDGER_FACTS}, e AS (SELECT max({fold('entity')}) AS e FROM ledger_resolutions) SELECT DISTINCT tenant_id, group_key FROM lf, e WHERE starts_with(group_key, e || '::')",
    "documents_elsewhere": f"WITH {_PLACES}, p AS (SELECT min((source_id, path)) AS p FROM places), l AS (SELECT document_id, count(*) AS n, bool_or(source_id = p[1] AND path = p[2]) AS here FROM places, p GROUP BY 1) SELECT document_id, n FROM l WHERE NOT coalesce(here, false)",
    "spend_within_ceiling": "WITH s AS (SELECT user_id, sum(value) FILTER (event_type = 'purchase') AS spent, sum(value) FILTER (event_type = 'signup') AS reserved FROM events GROUP BY 1) SELECT user_id, round(spent, 4) AS spent, round(reserved, 4) AS reserved FROM s WHERE coalesce(spent, 0) + coalesce(reserved, 0) + 50 <= 900",
    "confirmed_facts": f"WITH {LEDGER_FACTS} SELECT metric_slug, count(*) AS n FROM lf WHERE metric_slug IN (SELECT slug FROM measure_defs WHERE status = 'confirmed') GROUP BY 1",
    "sources_sorted": "SELECT source_id, source_name, kind FROM sources ORDER BY source_name DESC NULLS LAST, source_id LIMIT 10",
    "paragraph_order": "WITH p AS (SELECT DISTINCT document_version_id, paragraph_index, 'docx-paragraph:' || lpad(paragraph_index::VARCHAR, 10, '0') AS sort_key FROM docx_paragraphs) SELECT *, row_number() OVER (PARTITION BY document_version_id ORDER BY sort_key) AS place FROM p",
    "conflict_members_appended": f"WITH {STORED} SELECT conflict_id, len(list_distinct(list_append(fact_ids, winning_fact_id))) AS n FROM sc",
    "metric_candidates": f"WITH {LEDGER_FACTS} SELECT CASE WHEN metric_slug IS NULL THEN 'proposed' ELSE 'accepted' END AS origin, count(*) AS n, count(metric_slug) AS n_slugs FROM lf GROUP BY 1",
    "unknown_members": "SELECT 'documents' AS kind, count(*) AS n FROM (SELECT DISTINCT document_id FROM facts WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM file_states WHERE document_id IS NOT NULL)) UNION ALL SELECT 'facts', count(*) FROM (SELECT DISTINCT fact_id FROM facts WHERE fact_id NOT IN (SELECT unnest(fact_ids) FROM ledger_resolutions))",
    "flattened_citations": f"WITH {STORED} SELECT tenant_id AS answer_id, count(*) AS n_citations, count(DISTINCT conflict_id) AS n_claims, count(DISTINCT f) AS n_facts FROM (SELECT tenant_id, conflict_id, unnest(fact_ids) AS f FROM sc) GROUP BY 1",
    "flat_metric_rows": "SELECT 'documents.n' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'documents.parts.titled', count(title) FROM documents UNION ALL SELECT 'documents.parts.labelled', count(lang) FROM documents",
    "fact_lives": f"WITH {_VERSIONS} SELECT v.withdrawn_at IS NOT NULL AS withdrawn, coalesce(d.current_version_id <> f.document_version_id, false) AS superseded, count(*) AS n FROM f JOIN v USING (document_version_id) LEFT JOIN d USING (document_id) GROUP BY 1, 2",
    "live_fact_hits": f"WITH {_VERSIONS} SELECT document_id AS of_document, count(*) AS n FROM f JOIN v USING (document_version_id) WHERE withdrawn_at IS NULL GROUP BY 1",
    "standing_documents": f"WITH {_VERSIONS} SELECT document_id, current_version_id FROM d WHERE current_version_id IN (SELECT document_version_id FROM v WHERE withdrawn_at IS NULL)",
    "withdrawn_citations": f"WITH {_VERSIONS}, c AS (SELECT DISTINCT r.resolution_id AS answer_id, v.document_version_id AS x FROM (SELECT DISTINCT resolution_id, unnest(fact_ids) AS fact_id FROM ledger_resolutions) r JOIN f USING (fact_id) JOIN v USING (document_version_id) WHERE withdrawn_at IS NOT NULL) SELECT answer_id, string_agg(x::VARCHAR, ',' ORDER BY x) AS withdrawn_versions FROM c GROUP BY 1",
    "version_or_fork": f"WITH {_PLACES}, k AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS k FROM places) SELECT CASE WHEN k > 1 THEN 'fork' ELSE 'version' END AS action, CASE WHEN k > 1 THEN k - 1 ELSE k END AS n_locations, count(*) AS n FROM k GROUP BY 1, 2",
    "classes_applied": "WITH s AS (SELECT source_id, max(source_class) AS r FROM sources WHERE source_class IS NOT NULL GROUP BY 1), f AS (SELECT DISTINCT fact_id, source_id, source_class FROM facts) SELECT coalesce(r, source_class) AS source_class, count(*) AS n, count(*) FILTER (r IS NOT NULL AND source_class IS DISTINCT FROM r) AS n_changed FROM f LEFT JOIN s USING (source_id) GROUP BY 1",
    "measure_proposals": r"""WITH names AS (SELECT unnest([slug, label] || coalesce(aliases, [])) AS a FROM measure_defs), al AS (SELECT DISTINCT lower(trim(a)) AS a FROM names WHERE a IS NOT NULL),
u AS (SELECT DISTINCT fact_id, created_at, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(metric, '\([^)]*\)', '', 'g'), '[$%]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM facts WHERE lower(trim(metric)) NOT IN (SELECT a FROM al)),
k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY created_at, fact_id) AS rn FROM u WHERE regexp_full_match(slug, '[a-z][a-z0-9_]{0,63}'))
SELECT slug, count(*) AS n_facts, count(*) FILTER (rn <= 50) AS n_evidence, min(fact_id) FILTER (rn <= 50) AS first_evidence FROM k GROUP BY 1""",
    "measures_decided": "SELECT slug, CASE origin WHEN 'header' THEN 'confirmed' WHEN 'manual' THEN 'rejected' ELSE status END AS status, (measure_version + (origin = 'header')::INT)::INT AS measure_version, origin = 'header' AS rescan FROM measure_defs",
    "measures_with_defaults": "WITH d(value_type, u, n, how, t) AS (VALUES ('percentage', 'ratio', 2, 'absolute', 0.01::DOUBLE), ('currency', 'usd', 3, 'relative', 0.01), ('area', 'sf', 2, 'relative', 0.01), ('duration', 'years', 2, 'absolute', 0), ('count', 'count', 1, 'absolute', 0)) SELECT slug, CASE WHEN origin = 'seed' THEN canonical_unit ELSE u END AS canonical_unit, CASE WHEN origin = 'seed' THEN len(units) ELSE n END AS n_units, CASE WHEN origin = 'seed' THEN tolerance_kind ELSE how END AS tolerance_kind, CASE WHEN origin = 'seed' THEN tolerance ELSE t END AS tolerance FROM measure_defs LEFT JOIN d USING (value_type)",
    "conflict_list": _LISTED + "SELECT * FROM listed",
    "rulings_recorded": _LISTED + ", x AS (SELECT CASE WHEN status = 'open' AND len(fact_ids) > 0 THEN 'resolved' ELSE status END AS status, CASE WHEN status = 'open' THEN fact_ids[1] END AS w, CASE WHEN status = 'open' THEN fact_ids[1] = proposed_fact_id END AS followed_proposal FROM sc LEFT JOIN listed USING (conflict_id)) SELECT status, followed_proposal, count(*) AS n, count(w) AS n_ruled FROM x GROUP BY 1, 2",
    "inline_submissions": "WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS k FROM documents) SELECT doc_id AS submission_id, CASE WHEN text IS NULL OR doc_id % 50 = 3 THEN 'empty' WHEN doc_id % 50 IN (1, 2) AND k > 0 THEN 'not-base64' WHEN k = 0 THEN CASE WHEN doc_id % 50 = 2 THEN 'not-base64' ELSE 'empty' END END AS fault, CASE WHEN doc_id % 50 NOT IN (1, 2, 3) AND k > 0 THEN k END AS n_bytes, CASE WHEN doc_id % 50 NOT IN (1, 2, 3) AND k > 0 THEN sha256(text) END AS sha256 FROM d",
    "fenced_deliveries": "WITH a AS (SELECT DISTINCT concat_ws('/', source_id, sweep_no) AS job, delivery_no AS token, snapshot_at AS s, delivered_at AS e FROM source_sweeps) SELECT job, token, NOT EXISTS (SELECT 1 FROM a b WHERE b.job = a.job AND b.token > a.token AND b.s < a.e) AS accepted FROM a",
    "gate_outcomes": f"WITH {STORED} SELECT CASE WHEN resolved_at >= created_at AND resolved_at <= created_at + INTERVAL 24 HOURS THEN outcome ELSE 'timed_out' END AS outcome, count(*) AS n FROM sc GROUP BY 1",
    "recorded_views": "WITH RECURSIVE e AS (SELECT concat_ws('/', user_id, event_type) AS key, ts, event_id FROM events), r AS (SELECT key, min((ts, event_id)) AS x FROM e GROUP BY key UNION ALL SELECT key, x FROM (SELECT e.key, min((e.ts, e.event_id)) AS x FROM r JOIN e ON e.key = r.key AND e.ts >= r.x[1] + INTERVAL 6 HOURS GROUP BY e.key, r.x)) SELECT key, count(*) AS n, min(x[2]) AS first, max(x[2]) AS last FROM r GROUP BY 1",
    "hourly_counters": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 100) AS le_100, count(*) FILTER (value <= 1000) AS le_1000 FROM events GROUP BY 1, 2",
    "value_renderings": f"WITH r AS (SELECT DISTINCT resolution_id, amount, unit FROM ledger_resolutions WHERE amount IS NOT NULL), x AS (SELECT *, {_GROUPED.format('amount')} AS g, format('{{:.2f}}', amount) AS two FROM r), y AS (SELECT *, [replace(g, ',', ''), g, two] AS l FROM x), z AS (SELECT *, list_filter(l, lambda f, i: list_position(l, f) = i) AS forms FROM y) SELECT resolution_id, array_to_string(forms || CASE WHEN unit = 'percent' THEN list_transform(forms, lambda f: f || '%') ELSE [] END, '|') AS variants FROM z",
    "filing_renderings": f"WITH {_RENDERED} SELECT resolution_id, string_agg(text || 'x' || scale::VARCHAR, '|' ORDER BY scale) AS forms FROM forms GROUP BY resolution_id, measure, amount",
    "located_values": rf"""WITH {_RENDERED}, lab AS (SELECT slug AS measure, list_filter(string_split(lower(label), ' '), lambda w: length(w) > 3) AS words FROM measure_defs),
e AS (SELECT source_id, fact_id, max(raw_text) AS t FROM facts WHERE raw_text IS NOT NULL GROUP BY 1, 2),
fig AS (SELECT source_id, fact_id, t, unnest(list_distinct(regexp_extract_all(t, '\(?\d[\d,]*(?:\.\d+)?\)?'))) AS text FROM e),
met AS (SELECT f.resolution_id, g.fact_id, f.text, f.scale FROM forms f JOIN lab USING (measure) JOIN fig g ON g.source_id = f.source_id AND g.text = f.text WHERE len(list_filter(words, lambda w: contains(lower(g.t), w))) > 0),
one AS (SELECT resolution_id, fact_id, arg_min(text, scale) AS text, min(scale) AS scale FROM met GROUP BY 1, 2),
n AS (SELECT resolution_id, count(*) AS n, min(fact_id) AS fact_id, min(text) AS text, min(scale) AS scale FROM one GROUP BY 1)
SELECT v.resolution_id AS value_id, CASE WHEN n = 1 THEN fact_id END AS element_id, CASE WHEN n = 1 THEN text END AS text, CASE WHEN n = 1 THEN scale END AS scale, CASE WHEN n IS NULL THEN 'not-found' WHEN n > 1 THEN 'ambiguous' END AS reason
FROM (SELECT DISTINCT resolution_id, measure, amount FROM forms) v LEFT JOIN n USING (resolution_id)""",
    "corpus_sizing": "WITH d AS (SELECT coalesce(source_kind, 'none') AS form, coalesce(source_class, 'none') AS role, ceil(length(text)::DOUBLE / 2000) AS c, ceil(length(text)::DOUBLE / 4) AS t FROM documents) SELECT form, role, count(*) AS n_documents, round(avg(c), 6) AS mean_chunks, round(avg(t), 6) AS mean_tokens, round(sum(c) * 0.018, 6) AS cost, round(sum(c) * (2.5 / 3600), 6) AS hours FROM d GROUP BY 1, 2",
    "verdict_breakdown": _VERDICTS + "SELECT source_id, count(*) FILTER (verdict = 'grounded') AS grounded, count(*) FILTER (verdict = 'conflicting_evidence') AS conflicting_evidence, count(*) FILTER (verdict = 'not_grounded') AS not_grounded, count(*) FILTER (verdict = 'no_evidence_retrieved') AS no_evidence_retrieved, round((count(*) FILTER (verdict IN ('not_grounded', 'no_evidence_retrieved')))::DOUBLE / count(*), 6) AS failure_rate FROM v GROUP BY 1",
    "experiment_summary": _VERDICTS + ", a AS (SELECT count(*) AS n, count(*) FILTER (verdict = 'grounded') AS grounded, count(*) FILTER (verdict = 'not_grounded') AS not_grounded, count(*) FILTER (verdict = 'no_evidence_retrieved') AS no_evidence_retrieved, count(*) FILTER (verdict = 'conflicting_evidence') AS conflicting_evidence, count(*) FILTER (verdict = 'not_grounded' AND coalesce(unit, '') IN ('', 'n/a', 'tbd')) AS correct FROM v) SELECT n, grounded, not_grounded, no_evidence_retrieved, conflicting_evidence, round((not_grounded + no_evidence_retrieved)::DOUBLE / n, 6) AS failure_rate, (not_grounded + no_evidence_retrieved)::DOUBLE / n >= 0.2 AS failures_met, not_grounded AS n_sampled, 0 AS n_open, correct, not_grounded - correct AS false, CASE WHEN not_grounded > 0 THEN round(correct::DOUBLE / not_grounded, 6) END AS catch_rate, CASE WHEN not_grounded > 0 THEN correct::DOUBLE / not_grounded >= 0.7 END AS catches_met FROM a",
    "joined_verdicts": "WITH s AS (SELECT item_id AS no, category AS v FROM eval_items WHERE item_id % 3 > 0 UNION ALL SELECT item_id, 'answerable' FROM eval_items WHERE item_id % 10 = 1 UNION ALL SELECT -item_id - 1, 'answerable' FROM eval_items WHERE item_id % 40 = 0), o AS (SELECT no, count(*) AS k, min(v) AS v FROM s GROUP BY 1), j AS (SELECT CASE WHEN e.item_id IS NULL THEN 'outside' WHEN k IS NULL THEN 'missing' WHEN k > 1 THEN 'duplicate' END AS fault, v FROM eval_items e FULL JOIN o ON o.no = e.item_id) SELECT CASE WHEN fault IS NULL THEN v END AS verdict, fault, count(*) AS n FROM j GROUP BY 1, 2",
    "locator_overlaps": _CHUNKS + "SELECT case_id, chunk_id FROM o",
    "conflict_scope": _SCOPES + "SELECT case_id, bool_and(hit) AND count(chunk_id) > 0 AS in_scope FROM hits GROUP BY 1",
    "citation_precision": _SCOPES + "SELECT count(*) AS n_citations, round(coalesce(avg(hit::INT), 0), 6) AS precision FROM hits",
    "citation_indexes": _CHUNKS + f", k AS (SELECT case_id, chunk_id, list_filter(indexes, lambda i, n: coalesce({_Q.format('wanted')} <> '' AND contains({_Q.format('texts[n]')}, {_Q.format('wanted')}), false)) AS l FROM o WHERE file % 2 = 0) SELECT case_id, chunk_id, CASE WHEN len(l) = 1 THEN l[1] END AS paragraph_index FROM k",
}
