"""Queries of answers: support of claims, outcomes, ledger values, attestation, aliases and prose facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import table
from ledgerloom.functions.periods import ledger_period
from ledgerloom.functions.text import entity_fold
from ledgerloom.operators import aliases, answers, support
from ledgerloom.operators.ledger import ledger_facts, measure_aliases, measure_units, resolve_cells, stored_conflicts, written_unit
from ledgerloom.operators.listing import refuse_missing
from ledgerloom.plans.ledger_queries import _CELLS, _REGISTRY, registry_of
from ledgerloom.plans.listing_queries import _Q
from ledgerloom.plans.sql_parts import LEDGER_FACTS, STORED, fold
from ledgerloom.storage import durable


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return durable(ledger_facts(table(spark, folder, "facts"), table(spark, folder, "measure_defs")), "facts")


def _claims(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Resolved cells as claims in words, and the facts they cite (each the chunk that its quote is)."""
    r = table(spark, folder, "ledger_resolutions").where("state IN ('single', 'adjudicated') AND amount IS NOT NULL").dropDuplicates(["resolution_id"])
    labels = table(spark, folder, "measure_defs").select(F.col("slug").alias("measure"), "label", "canonical_unit")
    period = F.when(F.col("period_key").rlike(r"^\d{4}(-Q[1-4]|-\d{2})?$|^FY\d{4}$"), F.concat(F.lit(" in "), F.col("period_key"))).otherwise("")
    said = r.join(labels, "measure").select(
        F.col("resolution_id").alias("claim_id"), F.concat(F.initcap(F.trim("entity")), F.lit(": "), F.col("label"), F.lit(" is "), F.when(F.col("canonical_unit") == "usd", "$").otherwise(""), answers.plain_number(F.round("amount", 4)), F.when(F.col("canonical_unit") == "sf", " sf").when(F.col("canonical_unit") == "years", " years").otherwise(""), period, F.lit(".")).alias("statement"),
        F.array(entity_fold(F.col("entity"))).alias("subjects"), "fact_ids",
    )
    said = durable(said, "claims")
    return said.drop("fact_ids"), said.select("claim_id", F.explode("fact_ids").alias("chunk_id"))


def _unsupported(spark: SparkSession, folder: str) -> DataFrame:
    claims, citations = _claims(spark, folder)
    f = _facts(spark, folder)
    cells = f.where("metric_slug IS NOT NULL").select(F.col("fact_id").alias("chunk_id"), "entity_key", "metric_slug", "period_key", "canonical")
    return support.structured_support(claims, citations, f.select(F.col("fact_id").alias("chunk_id"), F.col("raw_text").alias("text")), cells, table(spark, folder, "measure_defs"))


def unsupported_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and periods of the resolutions' claims that no cited fact or text supports."""
    return _unsupported(spark, folder)


def supported_share(spark: SparkSession, folder: str) -> DataFrame:
    """Claims with and without full support."""
    claims, _ = _claims(spark, folder)
    bad = _unsupported(spark, folder).groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return claims.join(bad, "claim_id", "left").groupBy(F.coalesce("kinds", F.lit("")).alias("kinds")).agg(F.count("*").alias("n"))


def atom_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation passages taken apart into sentences; odd ones lose a sentence, some atoms fail."""
    e = table(spark, folder, "eval_items")
    atoms = e.select(F.col("item_id").alias("claim_id"), F.posexplode(F.split("text", r"(?<=[.]) ")).alias("pos", "atom")).where("NOT (claim_id % 2 = 1 AND pos = 0)").withColumn("atom_id", F.concat_ws("/", "claim_id", "pos"))
    dropped = atoms.where("claim_id % 6 = 0 AND pos = 1").select(F.col("atom_id").alias("id")).unionByName(e.where("item_id % 10 = 0").select(F.col("item_id").cast("string").alias("id")))
    claims = e.select(F.col("item_id").cast("string").alias("claim_id"), F.col("text").alias("statement"))
    return support.atom_verdicts(claims, atoms.withColumn("claim_id", F.col("claim_id").cast("string")), dropped).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


def _conflict_cells(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    c = stored_conflicts(table(spark, folder, "conflicts")).where("status = 'open'").select("conflict_id", F.explode("fact_ids").alias("fact_id"))
    cell = c.join(facts.where("metric_slug IS NOT NULL").select("fact_id", F.struct("entity_key", "metric_slug", "period_key").alias("cell")), "fact_id").groupBy("conflict_id").agg(F.min("cell").alias("cell"))
    return cell.select("conflict_id", "cell.*")


def question_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """The open conflicts that questions about the resolved cells would meet; every fifth question names no period."""
    r = table(spark, folder, "ledger_resolutions").dropDuplicates(["resolution_id"])
    period = F.when(F.col("resolution_id") % 5 > 0, F.col("period_key"))
    q = r.select(F.col("resolution_id").alias("question_id"), entity_fold(F.col("entity")).alias("entity"), "measure", period.alias("period"))
    return support.scoped_conflicts(q, _conflict_cells(spark, folder, _facts(spark, folder))).where("by_entity IS NOT NULL OR by_cell IS NOT NULL")


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    claims, citations = _claims(spark, folder)
    f = table(spark, folder, "facts").select("fact_id", "amount").distinct()
    values = stored_conflicts(table(spark, folder, "conflicts")).where("status = 'open'").select("conflict_id", F.explode("fact_ids").alias("fact_id")).join(f, "fact_id").select("conflict_id", F.col("fact_id").alias("chunk_id"), F.col("amount").alias("value"))
    return support.either_side(claims, citations, values)


def sides_taken(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that cite a value of an open conflict and state its number."""
    return _sides(spark, folder)


def answer_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What answers made of the resolutions come to: each state drafts its kind of answer, and conflicts do the rest."""
    r = table(spark, folder, "ledger_resolutions").dropDuplicates(["resolution_id"])
    q = question_conflicts(spark, folder)
    drafted = F.when(F.col("state").isin("single", "adjudicated"), "answered").when(F.col("state") == "conflicted", "conflicting_evidence").otherwise("insufficient_evidence")
    a = r.select(
        F.col("resolution_id").alias("answer_id"), drafted.alias("drafted"), (F.col("resolution_id") % 2 == 0).alias("hint"), F.coalesce(F.size("fact_ids"), F.lit(0)).alias("n_survived"), F.col("conflict_id").alias("touched_conflict"),
    ).join(q.select(F.col("question_id").alias("answer_id"), "by_entity", "by_cell"), "answer_id", "left").withColumn("taken_side", F.lit(None).cast("string"))
    return support.final_outcomes(a)


def ledger_values(spark: SparkSession, folder: str) -> DataFrame:
    """One cell for each resolution's (entity, measure, period), asked of the ledger."""
    r = table(spark, folder, "ledger_resolutions").dropDuplicates(["resolution_id"])
    period = ledger_period(F.col("period_key"), entity_fold(F.col("period_key")), F.col("period_key"))
    asked = r.select(F.col("resolution_id").alias("request_id"), "tenant_id", entity_fold(F.col("entity")).alias("entity_key"), "measure", period.alias("period_key"))
    cells = resolve_cells(_facts(spark, folder), stored_conflicts(table(spark, folder, "conflicts")))
    return answers.resolved_values(asked, cells, table(spark, folder, "measure_defs")).withColumn("canonical", F.round("canonical", 6))


def ledger_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The claims that facts with a known measure make, with their quotes."""
    f = _facts(spark, folder).where("metric_slug IS NOT NULL AND amount IS NOT NULL")
    labels = table(spark, folder, "measure_defs").select(F.col("slug").alias("metric_slug"), "label")
    facts = f.join(labels, "metric_slug").select("fact_id", F.col("entity_key").alias("entity"), F.col("label").alias("measure"), "amount", "unit", "raw_text", F.col("fact_id").alias("chunk_id"), F.contains(F.col("raw_text"), F.lit(" | ")).alias("from_cell"))
    return answers.ledger_claims(facts, f.select(F.col("fact_id").alias("chunk_id"), F.col("raw_text").alias("text")))


def bulk_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Resolutions' claims verified in bulk: their facts are offered, the first is cited, support decides."""
    claims, citations = _claims(spark, folder)
    offered = citations.groupBy("claim_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("c")).select("claim_id", F.posexplode("c").alias("rank", "chunk_id"))
    bad = _unsupported(spark, folder).groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    gate = claims.join(bad, "claim_id", "left").select("claim_id", F.when(F.col("kinds").isNull(), "survived").otherwise("dropped").alias("verdict"), F.coalesce("kinds", F.lit("")).alias("kinds"))
    return answers.verify_in_bulk(claims, offered, offered.where("rank = 0"), gate, _sides(spark, folder)).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


def attestation_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles of the resolutions as answers, cited by the facts they rest on; multiples of seven were attested before."""
    f = _facts(spark, folder)
    r = table(spark, folder, "ledger_resolutions").dropDuplicates(["resolution_id"]).select(F.col("resolution_id").alias("answer_id"), F.explode("fact_ids").alias("chunk_id"))
    cited = r.join(f.select(F.col("fact_id").alias("chunk_id"), "document_version_id"), "chunk_id")
    refuse_missing(r, f.select(F.col("fact_id").alias("chunk_id")), "chunk_id")
    before = r.where("answer_id % 7 = 0").select("answer_id", F.sha2(F.col("answer_id").cast("string"), 256).alias("content_hash")).distinct()
    return answers.attestations(cited, f.select("fact_id", F.col("fact_id").alias("chunk_id"), "metric_slug"), stored_conflicts(table(spark, folder, "conflicts")), before)


def harvested_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Names that documents and paragraphs define for entities of the ledger."""
    d = table(spark, folder, "documents").select(F.concat_ws("/", F.lit("d"), "doc_id").alias("text_id"), "text")
    p = table(spark, folder, "docx_paragraphs").select(F.concat_ws("/", F.lit("p"), "document_version_id", "paragraph_index").alias("text_id"), "text").distinct()
    return aliases.harvested_aliases(d.unionByName(p), durable(registry_of(spark, folder), "registry"))


def prose_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of the model's passes, their quotes checked against what the other passes read of the same document."""
    m = table(spark, folder, "measure_defs")
    listed = measure_aliases(m).join(measure_units(m).select("slug", "unit"), "slug")
    f = table(spark, folder, "facts").where("extraction_method = 'llm'").select("fact_id", F.lit(1).alias("pass"), F.col("raw_text").alias("text"), F.col("raw_text").alias("quote"), "entity_quote", "metric", written_unit(F.col("unit")).alias("unit")).distinct()
    f = durable(f, "candidates")  # a projection with Python functions must not be merged into the aggregation above
    return durable(aliases.prose_candidates(f, listed, durable(registry_of(spark, folder), "registry")), "prose").groupBy("reason", "metric_slug").agg(F.count("*").alias("n"), F.countDistinct("entity_key").alias("n_entities"))


QUERIES = {f.__name__: f for f in (unsupported_claims, supported_share, atom_verdicts, question_conflicts, sides_taken, answer_outcomes, ledger_values, ledger_answers, bulk_verdicts, attestation_bundles, harvested_aliases, prose_candidates)}

_OVERLAP = "(q.period = c.period_key OR coalesce(qf <= cl AND cf <= ql, false))"


def _spans(name: str, key: str) -> str:
    from ledgerloom.plans.sql_parts import span

    first, last = span(key)
    return f"{first} AS {name}f, {last} AS {name}l"


_SCOPED = f"""
WITH {LEDGER_FACTS}, {STORED}, mem AS (SELECT conflict_id, unnest(fact_ids) AS fact_id FROM sc WHERE status = 'open'),
c0 AS (SELECT conflict_id, min((entity_key, metric_slug, period_key)) AS cell FROM mem JOIN lf USING (fact_id) WHERE metric_slug IS NOT NULL GROUP BY 1),
c1 AS (SELECT conflict_id, cell[1] AS entity_key, cell[2] AS metric_slug, cell[3] AS period_key FROM c0),
c AS (SELECT *, {_spans('c', 'period_key')} FROM c1),
q0 AS (SELECT DISTINCT ON (resolution_id) resolution_id AS question_id, {fold('entity')} AS entity, measure, CASE WHEN resolution_id % 5 > 0 THEN period_key END AS period FROM ledger_resolutions),
q AS (SELECT *, {_spans('q', 'period')} FROM q0),
m AS (SELECT question_id, conflict_id, q.measure = c.metric_slug AND CASE WHEN q.period IS NULL THEN c.period_key = 'undated' ELSE {_OVERLAP} END AS fits FROM q JOIN c ON q.entity = c.entity_key),
k AS (SELECT question_id, count(DISTINCT conflict_id) AS n, min(conflict_id) AS one, count(DISTINCT conflict_id) FILTER (fits) AS nf, min(conflict_id) FILTER (fits) AS onef FROM m GROUP BY 1),
scoped AS (SELECT question_id, CASE WHEN n = 1 THEN one END AS by_entity, CASE WHEN nf = 1 THEN onef END AS by_cell FROM k)
"""
ORACLE = {
    "question_conflicts": _SCOPED + "SELECT * FROM scoped WHERE by_entity IS NOT NULL OR by_cell IS NOT NULL",
    "answer_outcomes": _SCOPED + """, r AS (SELECT DISTINCT ON (resolution_id) resolution_id, state, coalesce(len(fact_ids), 0) AS n, conflict_id, CASE WHEN state IN ('single', 'adjudicated') THEN 'answered' WHEN state = 'conflicted' THEN 'conflicting_evidence' ELSE 'insufficient_evidence' END AS d FROM ledger_resolutions),
b AS (SELECT r.*, by_cell, by_entity, CASE WHEN by_cell IS NOT NULL THEN 'question' WHEN d = 'insufficient_evidence' AND resolution_id % 2 = 0 AND by_entity IS NOT NULL THEN 'hint' WHEN d = 'insufficient_evidence' THEN 'abstained' WHEN d <> 'answered' THEN 'draft'
  WHEN n > 0 AND conflict_id IS NOT NULL THEN 'touched' WHEN n = 0 THEN 'nothing-survived' ELSE 'answered' END AS basis FROM r LEFT JOIN scoped s ON s.question_id = r.resolution_id)
SELECT resolution_id AS answer_id, CASE WHEN basis IN ('question', 'hint', 'touched') THEN 'conflicting_evidence' WHEN basis IN ('abstained', 'nothing-survived') THEN 'insufficient_evidence' WHEN basis = 'answered' THEN 'answered' ELSE d END AS outcome,
  CASE basis WHEN 'question' THEN by_cell WHEN 'hint' THEN by_entity WHEN 'touched' THEN conflict_id END AS conflict_id, basis FROM b""",
    "ledger_values": _CELLS + f""", r AS (SELECT DISTINCT ON (resolution_id) resolution_id, tenant_id, measure, concat_ws('::', {fold('entity')}, measure, CASE WHEN coalesce(trim(period_key), '') IN ('', 'undated') THEN 'undated' WHEN starts_with(period_key, 'undated:') THEN 'undated:' || trim(substr({fold('period_key')}, 9)) ELSE period_key END) AS group_key FROM ledger_resolutions)
SELECT resolution_id AS request_id, CASE WHEN d.slug IS NOT NULL THEN coalesce(c.state, 'unknown') END AS state, c.canonical, c.conflict_id, CASE WHEN d.slug IS NULL THEN 'measure-not-found' END AS fault
FROM r LEFT JOIN measure_defs d ON d.slug = r.measure LEFT JOIN cells c ON c.tenant_id = r.tenant_id AND c.group_key = r.group_key""",
    "attestation_bundles": f"""WITH {LEDGER_FACTS}, {STORED}, r AS (SELECT resolution_id AS a, unnest(fact_ids) AS fact_id FROM (SELECT DISTINCT ON (resolution_id) resolution_id, fact_ids FROM ledger_resolutions)),
ruled AS (SELECT conflict_id, unnest(fact_ids) AS fact_id FROM sc WHERE status = 'resolved'),
p AS (SELECT a, l.fact_id, l.metric_slug, l.document_version_id AS v, u.conflict_id AS x FROM r JOIN lf l USING (fact_id) LEFT JOIN ruled u USING (fact_id)),
b AS (SELECT a, count(DISTINCT v) AS n_versions, list_sort(list(DISTINCT v::VARCHAR)) AS vs, list_sort(list(DISTINCT fact_id)) AS fs, list_sort(list(DISTINCT metric_slug) FILTER (metric_slug IS NOT NULL)) AS ms, list_sort(list(DISTINCT x) FILTER (x IS NOT NULL)) AS xs FROM p GROUP BY 1),
s AS (SELECT a, n_versions, coalesce(array_to_string(fs, ','), '') AS facts, coalesce(array_to_string(ms, ','), '') AS measures, coalesce(array_to_string(xs, ','), '') AS resolutions, coalesce(array_to_string(vs, ','), '') AS versions FROM b),
h AS (SELECT *, sha256(versions || '|' || facts || '|' || measures || '|' || resolutions) AS content_hash FROM s)
SELECT a AS answer_id, n_versions, facts, measures, resolutions, content_hash, CASE WHEN a % 7 = 0 THEN sha256(a::VARCHAR) ELSE content_hash END AS first_hash FROM h""",
    "prose_candidates": f"""WITH {LEDGER_FACTS}, {_REGISTRY}, one AS (SELECT alias AS name, min(canonical_name) AS canonical_name FROM reg GROUP BY 1 HAVING count(DISTINCT canonical_name) = 1),
c AS (SELECT DISTINCT fact_id, raw_text, entity_quote, metric, coalesce(unit_id, trim(unit)) AS unit FROM facts LEFT JOIN written ON form = lower(trim(unit)) WHERE extraction_method = 'llm'),
q AS (SELECT *, {_Q.format('raw_text')} AS t, {_Q.format('entity_quote')} AS e FROM c),
j AS (SELECT q.*, a.slug, u.u.id AS listed, coalesce(o.canonical_name, {fold('entity_quote')}) AS entity_key FROM q LEFT JOIN aliases a ON lower(trim(q.metric)) = a.alias LEFT JOIN units u ON u.slug = a.slug AND u.u.id = q.unit LEFT JOIN one o ON o.name = {fold('entity_quote')}),
k AS (SELECT CASE WHEN coalesce(t, '') = '' THEN 'quote-not-found' WHEN NOT coalesce(e <> '' AND contains(t, e), false) THEN 'entity-not-in-quote' WHEN slug IS NULL THEN 'metric-not-listed' WHEN listed IS NULL THEN 'unit-not-listed' END AS reason, slug AS metric_slug, entity_key FROM j)
SELECT reason, metric_slug, count(*) AS n, count(DISTINCT entity_key) AS n_entities FROM k GROUP BY 1, 2""",
}
