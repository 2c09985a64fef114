"""Answers from the ledger, verification of claims in bulk, and the bundle that attests an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.claims import numbers_column, quote_alignment_column, unreadable_number_column
from ledgerloom.functions.text import quote_fold

#: A quote is at most this long; of a longer line the part around the value is taken.
LONGEST_QUOTE = 300


def resolved_values(requests: DataFrame, cells: DataFrame, measures: DataFrame) -> DataFrame:
    """One ledger cell per request: request_id, state, canonical, conflict_id, fault.

    ``requests``: request_id, tenant_id, entity_key, measure, period_key.  ``cells``: tenant_id, group_key, state, canonical, conflict_id.
    An unknown or rejected measure is a fault ('measure-not-found'); a proposed one has no value yet (unknown), nor has a cell
    without facts.
    """
    status = measures.select(F.col("slug").alias("measure"), F.col("status").alias("_status")).dropDuplicates(["measure"])
    asked = requests.join(status, "measure", "left").withColumn("group_key", F.concat_ws("::", "entity_key", "measure", "period_key"))
    found = asked.join(cells.select("tenant_id", "group_key", "state", "canonical", "conflict_id"), ["tenant_id", "group_key"], "left")
    bad = F.col("_status").isNull() | (F.col("_status") == "rejected")
    fault = F.when(bad, "measure-not-found")
    known = ~bad & (F.col("_status") != "proposed") & F.col("state").isNotNull()
    return found.select("request_id", F.when(~bad, F.when(known, F.col("state")).otherwise("unknown")).alias("state"), F.when(known, F.col("canonical")).alias("canonical"), F.when(known, F.col("conflict_id")).alias("conflict_id"), fault.alias("fault"))


def _number_text(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole, F.floor(value).cast("string")).otherwise(value.cast("decimal(38,10)").cast("string"))


def plain_number(value: Column) -> Column:
    """A number without exponent and without needless zeros."""
    return F.regexp_replace(F.regexp_replace(_number_text(value), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def quote_window(line: Column, value: Column) -> Column:
    """A line, or of one that is too long the part of LONGEST_QUOTE characters around the value (the start if it is not there)."""
    at, size = F.position(value, line), F.length(line)
    half = F.floor((LONGEST_QUOTE - F.length(value)) / 2)
    start = F.greatest(F.lit(1), F.least(at - half, size - LONGEST_QUOTE + 1)).cast("int")
    return F.when(size <= LONGEST_QUOTE, line).when(at == 0, F.left(line, F.lit(LONGEST_QUOTE))).otherwise(F.substring(line, start, F.lit(LONGEST_QUOTE)))


def ledger_claims(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """The claim a fact makes, in words, with its verbatim quote: fact_id, statement, quote, fault.

    ``facts``: fact_id, entity, measure, amount, unit, raw_text, chunk_id, from_cell (whether the amount was read from a cell).
    ``chunks``: chunk_id, text.  The amount is the quote's one number, else the fact's; the quote is the line of the chunk that
    holds the fact's text, else that text.  Faults: chunk-not-found; ambiguous-statement (other numbers beside the amount, or
    one nobody can read); quote-not-found; quote-unrelated (see quote_alignment).
    """
    require(facts, "fact_id", "entity", "measure", "amount", "unit", "raw_text", "chunk_id", "from_cell")
    j = facts.join(chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"]), "chunk_id", "left").withColumn("_n", numbers_column("raw_text"))
    value = F.when(~F.col("from_cell") & (F.size("_n") == 1), F.element_at("_n", 1)).otherwise(F.col("amount").cast("double"))
    j = j.withColumn("_value", value).withColumn("statement", F.concat(F.col("entity"), F.lit(": "), F.col("measure"), F.lit(" is "), plain_number(F.col("_value")), F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(".")))
    wanted = quote_fold(F.col("raw_text"))
    line = F.try_element_at(F.filter(F.split("text", "\n"), lambda x: (wanted != "") & F.contains(quote_fold(x), wanted)), F.lit(1))
    j = j.withColumn("quote", quote_window(F.coalesce(line, F.col("raw_text")), F.col("raw_text"))).withColumn("_stated", numbers_column("statement"))
    one = (F.size("_stated") == 1) & (F.element_at("_stated", 1) == F.col("_value")) & ~unreadable_number_column("statement")
    stands = (quote_fold(F.col("quote")) != "") & F.contains(quote_fold(F.col("text")), quote_fold(F.col("quote")))
    fault = F.when(F.col("text").isNull(), "chunk-not-found").when(~F.coalesce(one, F.lit(False)), "ambiguous-statement").when(~F.coalesce(stands, F.lit(False)), "quote-not-found")
    early = j.withColumn("_fault", fault).withColumn("_aligned", quote_alignment_column(F.when(F.col("_fault").isNull(), F.col("statement")), F.array("quote")))
    last = F.coalesce(F.col("_fault"), F.when(F.col("_aligned") != "aligned", "quote-unrelated"))
    return early.select("fact_id", F.when(last.isNull(), F.col("statement")).alias("statement"), F.when(last.isNull(), F.col("quote")).alias("quote"), last.alias("fault"))


def verify_in_bulk(claims: DataFrame, candidates: DataFrame, picks: DataFrame, gate: DataFrame, touched: DataFrame) -> DataFrame:
    """Verdict of claims somebody else drafted: claim_id, verdict, reason.

    ``claims``: claim_id.  ``candidates``: claim_id, rank, chunk_id (what retrieval offers).  ``picks``: claim_id, rank (the candidate that is
    cited, as recorded).  ``gate``: claim_id, verdict, kinds (check_claims on those citations).  ``touched``: claim_id, conflict_id.
    In order: nothing retrieved; no pick, or one outside the candidates; dropped by the gate; on a conflict; grounded.
    """
    offered = candidates.groupBy("claim_id").agg(F.count("*").alias("_n"))
    picked = picks.join(candidates, ["claim_id", "rank"]).groupBy("claim_id").agg(F.min("rank").alias("_rank"))
    g = gate.select("claim_id", F.col("verdict").alias("_gate"), "kinds").dropDuplicates(["claim_id"])
    t = touched.where("conflict_id IS NOT NULL").groupBy("claim_id").agg(F.min("conflict_id").alias("_conflict"))
    j = claims.select("claim_id").join(offered, "claim_id", "left").join(picked, "claim_id", "left").join(g, "claim_id", "left").join(t, "claim_id", "left")
    verdict = F.when(F.col("_n").isNull(), "no_evidence_retrieved").when(F.col("_rank").isNull() | (F.coalesce("_gate", F.lit("dropped")) != "survived"), "not_grounded").when(F.col("_conflict").isNotNull(), "conflicting_evidence").otherwise("grounded")
    reason = F.when(F.col("_n").isNull(), "nothing-retrieved").when(F.col("_rank").isNull(), "no-citation").when(F.coalesce("_gate", F.lit("dropped")) != "survived", F.coalesce("kinds", F.lit("not-checked"))).when(F.col("_conflict").isNotNull(), "conflict")
    return j.select("claim_id", verdict.alias("verdict"), reason.alias("reason"))


def attestations(citations: DataFrame, facts: DataFrame, conflicts: DataFrame, attested: DataFrame) -> DataFrame:
    """What an answer rests on, bundled and sealed: answer_id, n_versions, facts, measures, resolutions, content_hash, first_hash.

    ``citations``: answer_id, document_version_id, chunk_id.  ``facts``: fact_id, chunk_id, metric_slug.  ``conflicts``: conflict_id, fact_ids,
    status.  ``attested``: answer_id, content_hash of earlier bundles.  The hash is over the sorted ids of versions, facts,
    measures and resolved conflicts; a bundle attested before keeps its first hash.  An answer without citations has no bundle.
    """
    per_answer = lambda df, column: df.groupBy("answer_id").agg(F.array_sort(F.collect_set(F.col(column).cast("string"))).alias(column + "s"))
    own = citations.select("answer_id", "chunk_id").distinct().join(facts.select("fact_id", "chunk_id", "metric_slug"), "chunk_id").select("answer_id", "fact_id", "metric_slug").distinct()
    ruled = conflicts.where("status = 'resolved'").select("conflict_id", F.explode("fact_ids").alias("fact_id"))
    b = per_answer(citations, "document_version_id").join(per_answer(own, "fact_id"), "answer_id", "left").join(per_answer(own, "metric_slug"), "answer_id", "left").join(per_answer(own.join(ruled, "fact_id"), "conflict_id"), "answer_id", "left")
    part = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    lists = [part(F.col(c)) for c in ("document_version_ids", "fact_ids", "metric_slugs", "conflict_ids")]
    sealed = F.sha2(F.concat_ws("|", *lists), 256)
    first = attested.groupBy("answer_id").agg(F.min("content_hash").alias("_first"))
    return b.join(first, "answer_id", "left").select("answer_id", F.size("document_version_ids").alias("n_versions"), lists[1].alias("facts"), lists[2].alias("measures"), lists[3].alias("resolutions"), sealed.alias("content_hash"), F.coalesce("_first", sealed).alias("first_hash"))
