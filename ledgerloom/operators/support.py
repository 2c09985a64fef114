"""Binding the numbers and periods of claims to facts and texts, and what an answer comes to in the end.

Everything meets in joins by claim, chunk, entity and measure; tolerances and overlaps are conditions on what has met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.claims import assertions_column, content_tokens_column, numbers_column, unreadable_number_column
from ledgerloom.functions.periods import period_end, period_start, stated_periods, without_periods
from ledgerloom.functions.text import entity_fold, has_token
from ledgerloom.operators.ledger import within_tolerance
from ledgerloom.operators.questions import mentions
from ledgerloom.storage import durable


def ranged(rows: DataFrame, key: str) -> DataFrame:
    """Adds the first and the last day of a period key, so that comparing periods costs two comparisons of dates."""
    return rows.withColumn(f"{key}_from", period_start(F.col(key))).withColumn(f"{key}_to", period_end(F.col(key)))


def same_period(a: str, b: str) -> Column:
    """Whether two period columns (see ranged) mean one: the same key, or ranges that share a day."""
    overlap = (F.col(f"{a}_from") <= F.col(f"{b}_to")) & (F.col(f"{b}_from") <= F.col(f"{a}_to"))
    return (F.col(a) == F.col(b)) | F.coalesce(overlap, F.lit(False))


def _periods(texts: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """key, out: the periods that texts state.  The outer explode keeps Spark from guarding it by reading the text again."""
    return ranged(texts.select(key, F.explode_outer(stated_periods(F.col(text))).alias(out)).where(F.col(out).isNotNull()), out)


def _numbers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, no, value, kind, plain: the numbers of texts, without those that are part of a period."""
    masked = texts.select(key, F.posexplode_outer(assertions_column(without_periods(F.col(text)))).alias("no", "_a"))
    return masked.where("_a IS NOT NULL").select(key, "no", F.col("_a.value").alias("value"), F.col("_a.kind").alias("kind"), F.col("_a.plain").alias("plain"))


def _measure_rows(measures: DataFrame) -> DataFrame:
    return measures.select(F.col("slug").alias("metric_slug"), "value_type", "tolerance_kind", "tolerance").dropDuplicates(["metric_slug"])


def _phrases(measures: DataFrame) -> DataFrame:
    labels = measures.select(F.col("slug").alias("key"), F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("phrase"))
    return labels.where("phrase IS NOT NULL").select("key", entity_fold(F.col("phrase")).alias("phrase")).distinct()


def candidate_measures(numbers: DataFrame, claims: DataFrame, measures: DataFrame) -> DataFrame:
    """claim_id, no, metric_slug, tolerance_kind, tolerance, tried: the measures a number may belong to, and the values tried.

    A number with a kind may be of any measure of that kind; one without, of the measures its statement names.  A number
    without a sign under a percentage is tried as it is and as percent.
    """
    m = _measure_rows(measures)
    asked = claims.select(F.col("claim_id").alias("question_id"), entity_fold(F.col("statement")).alias("_q"))
    named = mentions(asked, _phrases(measures), False).select(F.col("question_id").alias("claim_id"), F.col("key").alias("metric_slug"))
    kinds = numbers.where("kind <> 'unknown'").join(m, F.col("kind") == F.col("value_type"))
    loose = numbers.where("kind = 'unknown'").join(named, "claim_id").join(m, "metric_slug")
    columns = ["claim_id", "no", "metric_slug", "tolerance_kind", "tolerance", "value_type", "kind", "value", "plain"]
    both = kinds.select(*columns).unionByName(loose.select(*columns))
    percent = (F.col("value_type") == "percentage") & (F.col("kind") == "unknown")
    tried = F.when(percent, F.array("plain", F.col("value") * 0.01)).otherwise(F.array("plain"))
    return both.select("claim_id", "no", "metric_slug", "tolerance_kind", "tolerance", F.explode(F.array_distinct(tried)).alias("tried"))


def _matching_facts(cited_facts: DataFrame, periods: DataFrame) -> DataFrame:
    """Facts of a claim's chunks that all its stated periods match."""
    off = cited_facts.select("claim_id", "period_key", "period_key_from", "period_key_to").distinct().join(periods, "claim_id").where(~same_period("period", "period_key")).select("claim_id", "period_key").distinct()
    return cited_facts.join(off, ["claim_id", "period_key"], "left_anti")


def structured_support(claims: DataFrame, citations: DataFrame, chunks: DataFrame, cell_facts: DataFrame, measures: DataFrame) -> DataFrame:
    """What is not supported of each claim: claim_id, kind, what.  A claim without rows is supported.

    ``claims``: claim_id, statement, subjects (array of folded entity names).  ``citations``: claim_id, chunk_id.  ``chunks``: chunk_id,
    text.  ``cell_facts``: chunk_id, entity_key, metric_slug, period_key, canonical.  ``measures``: slug, label, aliases, value_type,
    tolerance_kind, tolerance.

    A number is supported by a fact of a cited chunk: of a subject, of a measure it may belong to, in all periods the claim
    states, within the measure's tolerance.  Else by the text of a cited chunk: of one without facts a number within the
    tolerance; if no measure is in question, the same number in any.  A period is supported by a fact of a subject, or by
    the text of a cited chunk without facts.  Kinds: numeric-claim-unsupported (``what`` is the value in its plain unit, null
    for a number nobody can read), period-claim-unsupported (``what`` is null, the key is in ``period``).
    """
    require(claims, "claim_id", "statement", "subjects")
    require(citations, "claim_id", "chunk_id")
    numbers = durable(_numbers(claims.where("statement IS NOT NULL"), "claim_id", "statement"), "numbers")
    periods = durable(_periods(claims, "claim_id", "statement", "period"), "periods")
    cited = citations.select("claim_id", "chunk_id").distinct()
    subjects = claims.select("claim_id", F.explode("subjects").alias("entity_key")).distinct()
    facts = cell_facts.where("canonical IS NOT NULL").select("chunk_id", "entity_key", "metric_slug", "period_key", "canonical")
    own = durable(ranged(cited.join(facts, "chunk_id").join(subjects, ["claim_id", "entity_key"], "left_semi"), "period_key"), "own")
    candidates = durable(candidate_measures(numbers, claims, measures), "candidates")
    close = within_tolerance(F.col("tried"), F.col("canonical"), F.col("tolerance_kind"), F.col("tolerance"))
    bound = candidates.join(_matching_facts(own, periods).select("claim_id", "metric_slug", "canonical"), ["claim_id", "metric_slug"]).where(close).select("claim_id", "no").distinct()
    open_ = numbers.join(bound, ["claim_id", "no"], "left_anti")
    # What the cited texts say, once per chunk; chunks with facts only count for numbers that no measure is in question for.
    with_cells = facts.select("chunk_id").distinct().withColumn("_cells", F.lit(True))
    asked = cited.join(open_.select("claim_id").distinct(), "claim_id", "left_semi")
    said = _numbers(chunks.join(asked.select("chunk_id").distinct(), "chunk_id", "left_semi").where("text IS NOT NULL"), "chunk_id", "text").select("chunk_id", F.col("plain").alias("canonical")).distinct()
    near = asked.join(said, "chunk_id").join(with_cells, "chunk_id", "left")
    measured = candidates.select("claim_id", "no").distinct()
    plain = open_.join(measured, ["claim_id", "no"], "left_anti").join(near, "claim_id").where("plain = canonical").select("claim_id", "no")
    values = open_.select("claim_id", "no", F.col("plain").alias("tried"))
    kinds = candidates.select("claim_id", "no", "tolerance_kind", "tolerance").distinct()
    read = values.join(kinds, ["claim_id", "no"]).join(near.where("_cells IS NULL"), "claim_id").where(close).select("claim_id", "no")
    missing = open_.join(plain.unionByName(read).distinct(), ["claim_id", "no"], "left_anti")
    by_fact = periods.join(own.select("claim_id", "period_key", "period_key_from", "period_key_to").distinct(), "claim_id").where(same_period("period", "period_key")).select("claim_id", "period")
    open_periods = periods.join(by_fact.distinct(), ["claim_id", "period"], "left_anti")
    open_chunks = open_periods.join(cited, "claim_id")
    texts = _periods(chunks.join(with_cells, "chunk_id", "left_anti").join(open_chunks.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunk_id", "text", "period_key")
    by_text = open_chunks.join(texts, "chunk_id").where(same_period("period", "period_key")).select("claim_id", "period")
    none = F.lit(None)
    unreadable = claims.where(unreadable_number_column(without_periods(F.col("statement")))).select("claim_id", F.lit("numeric-claim-unsupported").alias("kind"), none.cast("double").alias("what"), none.cast("string").alias("period"))
    wrong = missing.select("claim_id", F.lit("numeric-claim-unsupported").alias("kind"), F.col("plain").alias("what"), none.cast("string").alias("period"))
    undated = open_periods.join(by_text.distinct(), ["claim_id", "period"], "left_anti").select("claim_id", F.lit("period-claim-unsupported").alias("kind"), none.cast("double").alias("what"), "period")
    return wrong.unionByName(undated).unionByName(unreadable)


def atom_verdicts(claims: DataFrame, atoms: DataFrame, dropped: DataFrame) -> DataFrame:
    """Verdict of claims that were taken apart: claim_id, verdict (survived or dropped), reason.

    ``claims``: claim_id, statement.  ``atoms``: claim_id, atom_id, atom.  ``dropped``: id of the claims and atoms that fail on their own.
    The whole claim is judged first ('whole').  Its atoms count only if their words and numbers are exactly the claim's
    ('not-covered' else, and the claim stands as a whole); then any failing atom drops it ('atom-unsupported').
    """
    own = claims.select("claim_id", content_tokens_column("statement").alias("own"))
    parts = atoms.select("claim_id", F.explode(content_tokens_column("atom")).alias("t")).groupBy("claim_id").agg(F.collect_set("t").alias("parts"))
    failing = atoms.join(dropped.select(F.col("id").alias("atom_id")), "atom_id", "left_semi").select("claim_id").distinct().withColumn("_bad", F.lit(True))
    whole = dropped.select(F.col("id").alias("claim_id")).distinct().withColumn("_whole", F.lit(True))
    j = own.join(parts, "claim_id", "left").join(failing, "claim_id", "left").join(whole, "claim_id", "left")
    covered = F.coalesce(F.array_sort("own") == F.array_sort("parts"), F.lit(False))
    reason = F.when(F.col("_whole"), "whole").when(~covered, "not-covered").when(F.col("_bad"), "atom-unsupported")
    return j.select("claim_id", F.when(F.coalesce(reason.isin("whole", "atom-unsupported"), F.lit(False)), "dropped").otherwise("survived").alias("verdict"), reason.alias("reason"))


def either_side(claims: DataFrame, citations: DataFrame, values: DataFrame) -> DataFrame:
    """Conflicts a claim takes a side in: claim_id, conflict_id (the first by name).

    ``claims``: claim_id, statement.  ``citations``: claim_id, chunk_id.  ``values``: conflict_id, chunk_id, value.  A claim that cites the
    chunk of a conflicting value and states its number takes a side.
    """
    stated = claims.select("claim_id", F.explode(F.array_distinct(numbers_column("statement"))).alias("value"))
    met = citations.select("claim_id", "chunk_id").distinct().join(values.select("conflict_id", "chunk_id", F.col("value").cast("double").alias("value")), "chunk_id").join(stated, ["claim_id", "value"])
    return met.groupBy("claim_id").agg(F.min("conflict_id").alias("conflict_id"))


def scoped_conflicts(questions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The one open conflict a question is about: question_id, by_entity, by_cell (conflict ids, null unless just one).

    ``questions``: question_id, entity, measure, period (null where the question names none, or not just one).  ``conflicts``:
    conflict_id, entity_key, metric_slug, period_key.  by_entity: the only conflict of the entity.  by_cell: the only one of entity
    and measure whose period shares a day with the question's; if it states none, whose facts are undated.
    """
    met = ranged(questions, "period").join(ranged(conflicts, "period_key"), F.col("entity") == F.col("entity_key"))
    fits = (F.col("measure") == F.col("metric_slug")) & F.when(F.col("period").isNull(), F.col("period_key") == "undated").otherwise(same_period("period", "period_key"))
    counts = met.groupBy("question_id").agg(F.countDistinct("conflict_id").alias("n"), F.min("conflict_id").alias("c"), F.countDistinct(F.when(fits, F.col("conflict_id"))).alias("m"), F.min(F.when(fits, F.col("conflict_id"))).alias("d"))
    return questions.select("question_id").join(counts, "question_id", "left").select("question_id", F.when(F.col("n") == 1, F.col("c")).alias("by_entity"), F.when(F.col("m") == 1, F.col("d")).alias("by_cell"))


def final_outcomes(answers: DataFrame) -> DataFrame:
    """What each answer comes to: answer_id, outcome, conflict_id, basis.

    ``answers``: answer_id, drafted (answered, insufficient_evidence or another), hint (whether the draft abstained because its
    evidence contradicts itself), n_survived, touched_conflict, by_cell, by_entity, taken_side (conflict ids or null).  In order: the
    question's own conflict pre-empts everything; an abstention stands, but for one with a hint where the entity has just one
    conflict; other drafts stand; a surviving claim on a conflicted key; no claim survives; a claim that takes a side; answered.
    """
    drafted = F.col("drafted")
    basis = (
        F.when(F.col("by_cell").isNotNull(), "question").when((drafted == "insufficient_evidence") & F.col("hint") & F.col("by_entity").isNotNull(), "hint").when(drafted == "insufficient_evidence", "abstained")
        .when(drafted != "answered", "draft").when((F.col("n_survived") > 0) & F.col("touched_conflict").isNotNull(), "touched").when(F.col("n_survived") == 0, "nothing-survived").when(F.col("taken_side").isNotNull(), "side").otherwise("answered")
    )
    b = F.col("basis")
    outcome = F.when(b.isin("question", "hint", "touched", "side"), "conflicting_evidence").when(b.isin("abstained", "nothing-survived"), "insufficient_evidence").when(b == "answered", "answered").otherwise(drafted)
    conflict = F.when(b == "question", F.col("by_cell")).when(b == "hint", F.col("by_entity")).when(b == "touched", F.col("touched_conflict")).when(b == "side", F.col("taken_side"))
    return answers.withColumn("basis", basis).select("answer_id", outcome.alias("outcome"), conflict.alias("conflict_id"), "basis")


def in_text(phrase: Column, text: Column) -> Column:
    """Whether a folded phrase stands in a text as words of its own."""
    return F.coalesce(has_token(entity_fold(text), phrase), F.lit(False))
