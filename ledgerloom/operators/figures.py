"""Figures as they are written, found again in texts, sampled for review, and what reading a corpus would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import require

SCALES = (1, 1_000, 1_000_000)
#: At most so many cases are reviewed by a person; and a population above the second bound is refused (its order is drawn).
SAMPLE, POPULATION = 20, 1_000_000
LEAST_FAILURES, LEAST_CATCHES = 0.2, 0.7
#: A written figure: digits in groups or not, two decimals or none, in parentheses if negative.
FIGURE = r"\(?\d[\d,]*(?:\.\d+)?\)?"


def _ungrouped(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def value_variants(value: Column, unit: Column) -> Column:
    """How a conflicting value may be written: plain, with grouped digits, with two decimals; for percent also with a % sign.

    Without repeated forms; null for a null value.  Beyond ten decimals nothing is written.
    """
    grouped = F.regexp_replace(F.format_number(value, 10), r"\.?0+$", "")
    forms = F.array_distinct(F.array(_ungrouped(grouped), grouped, _ungrouped(F.format_number(value, 2))))
    return F.when(value.isNotNull(), F.when(unit == "percent", F.concat(forms, F.transform(forms, lambda f: F.concat(f, F.lit("%"))))).otherwise(forms))


def _parenthesised(text: Column, negative: Column) -> Column:
    return F.when(negative, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def rendered_forms(value: Column, value_type: Column) -> Column:
    """How a filing may write a value: array of (text, scale), the smallest scale first; negative ones in parentheses.

    Money is written whole, in thousands or in millions (a form that repeats counts with its smaller scale), per-share values
    with two decimals, everything else whole.
    """
    whole = lambda v: _parenthesised(F.format_number(F.abs(F.floor(v + 0.5)), 0), F.floor(v + 0.5) < 0)
    cents = F.floor(value * 100 + 0.5) / 100
    form = lambda text, scale: F.struct(text.alias("text"), F.lit(scale).alias("scale"))
    money = F.array(*[form(whole(value / s), s) for s in SCALES])
    texts = F.transform(money, lambda f: f["text"])
    once = F.filter(money, lambda f, i: F.array_position(texts, f["text"]) == i + 1)
    share = F.array(form(_parenthesised(_ungrouped(F.format_number(F.abs(cents), 2)), cents < 0), 1))
    return F.when(value.isNotNull(), F.when(value_type == "per-share", share).when(value_type == "currency", once).otherwise(F.array(form(whole(value), 1))))


def locate_values(values: DataFrame, elements: DataFrame) -> DataFrame:
    """Where a value stands in its file: value_id, element_id, text, scale, reason (null, not-found or ambiguous).

    ``values``: value_id, file, forms (of rendered_forms), labels (array of words).  ``elements``: file, element_id, text, label.
    An element matches if it holds one of the forms as a whole figure and its label holds one of the words, letter case aside;
    of several forms in an element the first counts.  Exactly one element must match.  Values and elements meet in the figure
    (an equi join), so that a file is never compared with all values.
    """
    require(values, "value_id", "file", "forms", "labels")
    wanted = values.select("value_id", "file", "labels", F.posexplode("forms").alias("_pos", "_f")).select("value_id", "file", "labels", "_pos", F.col("_f.text").alias("figure"), F.col("_f.scale").alias("scale"))
    figures = elements.select("file", "element_id", F.lower("label").alias("label"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({FIGURE})"), F.lit(1)))).alias("figure"))
    met = wanted.join(figures, ["file", "figure"]).where(F.exists("labels", lambda w: F.contains(F.col("label"), F.lower(w))))
    one = met.groupBy("value_id", "element_id").agg(F.min(F.struct("_pos", "figure", "scale")).alias("m"))
    found = one.groupBy("value_id").agg(F.count("*").alias("n"), F.min(F.struct("element_id", "m")).alias("x"))
    n = F.coalesce(F.col("n"), F.lit(0))
    only = lambda c: F.when(n == 1, F.col(c))
    return values.select("value_id").join(found, "value_id", "left").select("value_id", only("x.element_id").alias("element_id"), only("x.m.figure").alias("text"), only("x.m.scale").alias("scale"), F.when(n == 0, "not-found").when(n > 1, "ambiguous").alias("reason"))


def corpus_sizing(chunks: DataFrame, passes: int, input_tokens: float, output_tokens: float, input_price: float, output_price: float, seconds: float, concurrency: int) -> DataFrame:
    """Means per (form, role), and what reading them would cost: form, role, n_documents, mean_chunks, mean_tokens, cost, hours.

    ``chunks``: form, role, document_id, n_chunks, n_tokens, one row per document.  Prices are per million tokens; every chunk is
    read ``passes`` times, ``concurrency`` at a time.
    """
    per_chunk = passes * (input_tokens * input_price + output_tokens * output_price) / 1e6
    sums = chunks.groupBy("form", "role").agg(F.count("*").alias("n_documents"), F.avg("n_chunks").alias("mean_chunks"), F.avg("n_tokens").alias("mean_tokens"), F.sum("n_chunks").alias("_n"))
    return sums.select("form", "role", "n_documents", "mean_chunks", "mean_tokens", (F.col("_n") * per_chunk).alias("cost"), (F.col("_n") * (seconds / concurrency / 3600)).alias("hours"))


def seeded(seed: int):
    """A stream of numbers in [0, 1) from a 32-bit seed: the public-domain generator mulberry32, so that samples can be
    repeated elsewhere.
    """
    state, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & mask
        a = ((state ^ state >> 15) * (state | 1)) & mask
        b = (a + ((a ^ a >> 7) * (a | 61) & mask) & mask) ^ a
        yield (b ^ b >> 14) / 2**32


def drawn(population: int, seed: int, most: int = SAMPLE) -> list[int]:
    """Numbers of the sampled members, ascending: the first places of a shuffle from the end."""
    if population > POPULATION:
        raise ValueError(f"a population above {POPULATION} is not drawn by shuffling")
    if population <= most:
        return list(range(population))
    order, numbers = list(range(population)), seeded(seed)
    for last in range(population - 1, 0, -1):
        other = int(next(numbers) * (last + 1))
        order[last], order[other] = order[other], order[last]
    return sorted(order[:most])


def adjudication_sample(cases: DataFrame, order: str, seed: int) -> DataFrame:
    """At most SAMPLE rows for review, in the order of ``order`` (a unique column), the same ones for one seed.

    The ids of the population, POPULATION at most, are numbered in one task; nothing but the drawn places reaches the driver.
    """
    n = cases.count()
    places = drawn(n, seed)
    if len(places) == n:
        return cases
    numbered = cases.select(order).withColumn("_at", F.row_number().over(Window.orderBy(order)) - 1)
    return cases.join(numbered.where(F.col("_at").isin(places)).select(order), order, "left_semi")


def joined_verdicts(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drafted claims with their verdicts by number, and what is wrong: claim_no, claim_id, verdict, fault.

    ``claims``: claim_no, claim_id.  ``verdicts``: claim_no, verdict.  Faults: 'missing', 'duplicate' and 'outside' (a verdict without
    claim).  A batch without faults is joined one to one.
    """
    one = verdicts.groupBy("claim_no").agg(F.count("*").alias("n"), F.min("verdict").alias("verdict"))
    joined = claims.select("claim_no", "claim_id").join(one, "claim_no", "full_outer")
    fault = F.when(F.col("claim_id").isNull(), "outside").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return joined.select("claim_no", "claim_id", F.when(fault.isNull(), F.col("verdict")).alias("verdict"), fault.alias("fault"))


def experiment_summary(outcomes: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: n, grounded, not_grounded, no_evidence_retrieved, conflicting_evidence, failure_rate, failures_met, n_sampled,
    n_open, correct, false, catch_rate, catches_met.

    ``outcomes``: claim_id, verdict.  ``reviews``: claim_id, review (correct_catch, false_catch or null), the sampled ones.  The catch
    rate and its bar are null until every sampled claim is reviewed.
    """
    kinds = ("grounded", "not_grounded", "no_evidence_retrieved", "conflicting_evidence")
    v = outcomes.agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])
    r = reviews.agg(F.count("*").alias("n_sampled"), F.count_if(F.col("review").isNull()).alias("n_open"), F.count_if(F.col("review") == "correct_catch").alias("correct"), F.count_if(F.col("review") == "false_catch").alias("false"))
    both = v.crossJoin(F.broadcast(r))  # one row each
    failures = F.coalesce(F.try_divide(F.col("not_grounded") + F.col("no_evidence_retrieved"), F.col("n")), F.lit(0.0))
    catches = F.when((F.col("n_open") == 0) & (F.col("n_sampled") > 0), F.col("correct") / F.col("n_sampled"))
    return both.select("n", *kinds, failures.alias("failure_rate"), (failures >= LEAST_FAILURES).alias("failures_met"), "n_sampled", "n_open", "correct", "false", catches.alias("catch_rate"), (catches >= LEAST_CATCHES).alias("catches_met"))
