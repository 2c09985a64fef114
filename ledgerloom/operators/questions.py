"""Reading questions: which entity, measure and period they ask about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.claims import numbers_column
from ledgerloom.functions.periods import stated_periods
from ledgerloom.functions.text import digit_numbers, entity_fold, has_ascii_token, has_token


def mentions(questions: DataFrame, phrases: DataFrame, ascii_only: bool) -> DataFrame:
    """(question_id, key) of phrases that occur in a question.

    Questions and phrases meet in a shared word first (an equi join on the phrase's longest word), so that the containment
    test sees few pairs instead of all.
    """
    word = r"[^\p{L}\p{N}]+"
    q = questions.select("question_id", "_q", F.explode(F.array_distinct(F.split("_q", word))).alias("_w")).where("_w <> ''")
    longest = F.aggregate(F.split("phrase", word), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    p = phrases.withColumn("_w", longest).where("_w <> ''")
    test = has_ascii_token if ascii_only else has_token
    return q.join(p, "_w").where(test(F.col("_q"), F.col("phrase"))).select("question_id", "key").distinct()


def resolve_questions(questions: DataFrame, entities: DataFrame, measures: DataFrame) -> DataFrame:
    """question_id, entity, measure, period, reason (null if resolved).

    ``questions``: question_id, question.  ``entities``: key, phrase (folded name or alias).  ``measures``: key, phrase
    (folded label or alias).  Reasons in order: no-entity, ambiguous-entity, no-measure, ambiguous-measure,
    ambiguous-period, numeric-constraint (a number that the one period does not explain).
    """
    require(questions, "question_id", "question")
    folded = questions.select("question_id", "question", entity_fold(F.col("question")).alias("_q"))
    count = lambda m, a: m.groupBy("question_id").agg(F.count("*").alias(f"n_{a}"), F.min("key").alias(a))
    named = count(mentions(folded, entities, True), "entity").join(count(mentions(folded, entities, False), "any"), "question_id", "full_outer")
    asked = folded.join(named, "question_id", "left").join(count(mentions(folded, measures, False), "measure"), "question_id", "left")
    asked = asked.withColumn("_p", stated_periods(F.col("question"))).withColumn("_n", numbers_column("question"))
    explained = F.when(F.size("_p") == 1, digit_numbers(F.try_element_at("_p", F.lit(1)))).otherwise(F.array().cast("array<double>"))
    loose = F.size(F.array_except("_n", explained)) > 0
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = (
        F.when(none("n_entity") != 1, F.when(none("n_any") > 0, "ambiguous-entity").otherwise("no-entity"))
        .when(none("n_measure") == 0, "no-measure").when(none("n_measure") > 1, "ambiguous-measure").when(F.size("_p") > 1, "ambiguous-period").when(loose, "numeric-constraint")
    )
    r = asked.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return r.select("question_id", F.when(ok, F.col("entity")).alias("entity"), F.when(ok, F.col("measure")).alias("measure"), F.when(ok, F.try_element_at("_p", F.lit(1))).alias("period"), "reason")
