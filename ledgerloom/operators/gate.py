"""Checking drafted claims against what they cite, in bulk: every claim is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.claims import locate_quote_column, numbers_column, quote_alignment_column


def check_claims(claims: DataFrame, citations: DataFrame, chunks: DataFrame, cell_values: DataFrame) -> DataFrame:
    """Verdict of each claim: claim_id, verdict (survived or dropped), stage, kinds (sorted, joined by comma).

    ``claims``: claim_id, statement.  ``citations``: claim_id, chunk_id, quote.  ``chunks``: chunk_id, text (those that
    were retrieved).  ``cell_values``: chunk_id, amount (facts read from a chunk's cells).

    Stages, the first that fails drops the claim: 1 every quote stands verbatim in a retrieved chunk; 2 the quotes carry
    the statement; 3 each number of the statement is a cell value of a cited chunk, or stands in a cited chunk that has no
    cell values.  A claim without citations is dropped at stage 1.  Joins are by id; a chunk's text meets only the quotes
    that cite it.
    """
    require(claims, "claim_id", "statement")
    require(citations, "claim_id", "chunk_id", "quote")
    cited = citations.join(chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"]), "chunk_id", "left")
    located = cited.withColumn("_at", locate_quote_column("quote", "text")).select(
        "claim_id", "chunk_id", "quote", "text",
        F.when(F.col("text").isNull(), "chunk-not-retrieved").when(F.col("_at.kind") == "none", "quote-not-found").when(F.col("_at.kind") == "fuzzy", "quote-fuzzy-match").alias("fault"),
    )
    per_claim = located.groupBy("claim_id").agg(F.array_sort(F.collect_set("fault")).alias("faults"), F.array_sort(F.collect_list("quote")).alias("quotes"))
    staged = claims.select("claim_id", "statement").join(per_claim, "claim_id", "left").withColumn("_aligned", quote_alignment_column("statement", "quotes"))
    stated = claims.select("claim_id", F.explode(F.array_distinct(numbers_column("statement"))).alias("number"))
    values = cell_values.where("amount IS NOT NULL").select("chunk_id", F.col("amount").cast("double").alias("number")).distinct()
    with_cells = values.select("chunk_id").distinct().withColumn("_cells", F.lit(True))
    chunk_numbers = located.join(with_cells, "chunk_id", "left").where("_cells IS NULL AND text IS NOT NULL").select("chunk_id", "text").dropDuplicates(["chunk_id"]).select("chunk_id", F.explode(F.array_distinct(numbers_column("text"))).alias("number"))
    known = located.select("claim_id", "chunk_id").distinct().join(values.unionByName(chunk_numbers), "chunk_id").select("claim_id", "number").distinct()
    unsupported = stated.join(known, ["claim_id", "number"], "left_anti").groupBy("claim_id").agg(F.count("*").alias("_open"))
    checked = staged.join(unsupported, "claim_id", "left")
    at_one = F.size(F.coalesce("faults", F.array())) > 0
    stage = F.when(F.col("quotes").isNull() | at_one, 1).when(F.col("_aligned") != "aligned", 2).when(F.col("_open") > 0, 3)
    kinds = F.when(F.col("quotes").isNull(), "no-citation").when(at_one, F.array_join("faults", ",")).when(F.col("_aligned") == "quote-not-substantive", "quote-not-substantive").when(F.col("_aligned") != "aligned", "quote-unrelated-to-statement").when(F.col("_open") > 0, "numeric-claim-unsupported").otherwise("")
    return checked.select("claim_id", F.when(stage.isNull(), "survived").otherwise("dropped").alias("verdict"), stage.alias("stage"), kinds.alias("kinds"))


def grounding_report(verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """Per answer: answer_id, n_claims, n_survived, coverage, outcome.  ``claims``: claim_id, answer_id, conflicted (boolean).

    A surviving claim on a conflicted key makes the answer conflicting; none surviving makes it insufficient.
    """
    joined = claims.join(verdicts, "claim_id", "left")
    ok = F.col("verdict") == "survived"
    sums = joined.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.count_if(ok).alias("n_survived"), F.bool_or(ok & F.coalesce(F.col("conflicted"), F.lit(False))).alias("_conflict"))
    outcome = F.when(F.col("_conflict"), "conflicting_evidence").when(F.col("n_survived") == 0, "insufficient_evidence").otherwise("answered")
    return sums.select("answer_id", "n_claims", "n_survived", F.round(F.try_divide("n_survived", "n_claims"), 6).alias("coverage"), outcome.alias("outcome"))
