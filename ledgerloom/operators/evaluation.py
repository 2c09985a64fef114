"""Measures of retrieval and answers.  Every rate over nothing is 0 (or null, where said), never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(hit: Column, among: Column | None = None) -> Column:
    """Share of rows where ``hit``, among those where ``among``; 0 if there are none.  Null is no hit."""
    base = F.count_if(among) if among is not None else F.count("*")
    top = F.count_if(hit & among) if among is not None else F.count_if(hit)
    return F.coalesce(F.try_divide(top, base), F.lit(0.0))


def applicable_rate(check: Column) -> Column:
    """Share of true among non-null checks; 0 if all are null."""
    return F.coalesce(F.avg(check.cast("int")), F.lit(0.0))


def ratio_of_sums(a: Column, b: Column) -> Column:
    """Sum over sum; 0 if the lower one is 0."""
    return F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))


def retrieval_quality(hits: DataFrame, depths: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row: n_cases, recall_at_k for each depth, mrr.  ``hits``: case_id, rank (from 1), overlap (boolean).

    Cases without hits are absent from it and do not count.
    """
    cases = hits.groupBy("case_id").agg(F.min(F.when(F.col("overlap"), F.col("rank"))).alias("first"))
    return cases.agg(
        F.count("*").alias("n_cases"), *[rate(F.col("first") <= k).alias(f"recall_at_{k}") for k in depths],
        F.coalesce(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
    )


def case_variance(observations: DataFrame) -> DataFrame:
    """Per case over several runs: n_runs, n_outcomes, flipped, answered_every_run, n_citation_sets, min/max/mode of claims.

    ``observations``: case_id, run, outcome, cited (array of ids), n_claims.  The mode is the smallest of the most frequent.
    """
    key = F.array_join(F.array_sort(F.array_distinct("cited")), ",")
    return observations.groupBy("case_id").agg(
        F.countDistinct("run").alias("n_runs"), F.countDistinct("outcome").alias("n_outcomes"), (F.countDistinct("outcome") > 1).alias("flipped"),
        F.bool_and(F.col("outcome") == "answered").alias("answered_every_run"), F.countDistinct(key).alias("n_citation_sets"),
        F.min("n_claims").alias("min_claims"), F.max("n_claims").alias("max_claims"), F.mode("n_claims", True).alias("mode_claims"),
    )


def compare_to_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics on both sides: metric, current, baseline, status.  ``baseline`` has higher_is_better as well.

    A full join: a metric missing on one side is 'new' or 'missing'; else 'regressed', 'improved' or 'same'.
    """
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline"), "higher_is_better"), "metric", "full_outer")
    better = F.when(F.col("higher_is_better"), F.col("current") - F.col("baseline")).otherwise(F.col("baseline") - F.col("current"))
    status = F.when(F.col("baseline").isNull(), "new").when(F.col("current").isNull(), "missing").when(better < 0, "regressed").when(better > 0, "improved").otherwise("same")
    return both.select("metric", "current", "baseline", status.alias("status"))


def evaluate_bars(current: DataFrame, bars: DataFrame) -> DataFrame:
    """Whether each metric meets its bar: metric, value, bar, kind (min or max), passed.  A missing metric fails."""
    passed = F.when(F.col("kind") == "min", F.col("value") >= F.col("bar")).otherwise(F.col("value") <= F.col("bar"))
    return bars.join(current, "metric", "left").select("metric", "value", "bar", "kind", F.coalesce(passed, F.lit(False)).alias("passed"))
