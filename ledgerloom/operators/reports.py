"""Filings, layouts, answers and costs: smaller operators that feed reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.text import cell_parts
from ledgerloom.operators.sheets import rectangles_overlap


def select_filings(submissions: DataFrame, forms: list[str], since: str, until: str) -> DataFrame:
    """Filings of companies that are stored as parallel arrays: cik, accession, form, filed.

    ``submissions``: cik, accession, form, filed (arrays of one length; a shorter one counts as null beyond its end).  Forms
    outside ``forms`` and dates outside the inclusive range are left out, as are null dates.
    """
    require(submissions, "cik", "accession", "form", "filed")
    rows = submissions.select("cik", F.explode(F.arrays_zip("accession", "form", "filed")).alias("f")).select("cik", "f.*")
    return rows.where(F.col("form").isin(forms) & F.col("filed").between(since, until))


def range_rectangle(address: Column) -> Column:
    """Struct (top, left, bottom, right) of an A1 cell or range; null fields if it is none."""
    a, b = cell_parts(F.substring_index(address, ":", 1)), cell_parts(F.substring_index(address, ":", -1))
    return F.struct(F.least(a["row"], b["row"]).alias("top"), F.least(a["column"], b["column"]).alias("left"), F.greatest(a["row"], b["row"]).alias("bottom"), F.greatest(a["column"], b["column"]).alias("right"))


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Pairs of ranges of one sheet that share a cell: sheet, a, b (a before b).  Ranges meet in blocks of 32 rows first."""
    boxed = ranges.select("sheet", "address", range_rectangle(F.col("address")).alias("box")).where("box.top IS NOT NULL")
    spread = boxed.withColumn("_block", F.explode(F.sequence(F.floor(F.col("box.top") / 32), F.floor(F.col("box.bottom") / 32))))
    left = spread.select("sheet", "_block", F.col("address").alias("a"), F.col("box").alias("_a"))
    right = spread.select("sheet", "_block", F.col("address").alias("b"), F.col("box").alias("_b"))
    return left.join(right, ["sheet", "_block"]).where((F.col("a") < F.col("b")) & rectangles_overlap(F.col("_a"), F.col("_b"))).select("sheet", "a", "b").distinct()


def contains_expected(answer: Column, expected: Column) -> Column:
    """Whether a text holds every expected string, letter case and blanks aside, without splitting a number.

    A string that begins or ends with a digit must not be part of a longer number there; no expected strings: null.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    before = lambda e: F.when(e.rlike(r"^\d"), r"(?<![\d])(?<!\d[.,])").otherwise("")
    after = lambda e: F.when(e.rlike(r"\d$"), r"(?!\d)(?![.,]\d)").otherwise("")
    found = F.forall(F.transform(expected, plain), lambda e: F.regexp_like(plain(answer), F.concat(before(e), F.lit(r"\Q"), e, F.lit(r"\E"), after(e))))
    return F.when(F.size(expected) > 0, found)


def canary_leaks(outcomes: DataFrame, tokens: list[str]) -> DataFrame:
    """Per case and planted token: case_id, token, n_total, n_quoted, own_voice (it occurs outside verified quotes).

    ``outcomes``: case_id, text, quotes (array).
    """
    require(outcomes, "case_id", "text", "quotes")
    each = outcomes.select("case_id", "text", "quotes", F.explode(F.array(*map(F.lit, tokens))).alias("token"))
    count = lambda c, t: F.coalesce(((F.length(c) - F.length(F.replace(c, t, F.lit("")))) / F.length(t)).cast("int"), F.lit(0))
    sums = each.select("case_id", "token", count(F.col("text"), F.col("token")).alias("n_total"), F.aggregate(F.coalesce("quotes", F.array().cast("array<string>")), F.lit(0), lambda a, q: a + count(q, F.col("token"))).alias("n_quoted"))
    return sums.withColumn("own_voice", F.col("n_total") > F.col("n_quoted"))


def token_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per model: model, n_calls, cost; null where a model has no price (it is not taken as free).

    ``usage``: model, input_tokens, output_tokens; ``prices``: model, input_per_million, output_per_million.
    """
    cost = (F.coalesce("input_tokens", F.lit(0)) * F.col("input_per_million") + F.coalesce("output_tokens", F.lit(0)) * F.col("output_per_million")) / 1_000_000
    return usage.join(prices, "model", "left").groupBy("model").agg(F.count("*").alias("n_calls"), F.when(F.count_if(F.col("input_per_million").isNull()) == 0, F.round(F.sum(cost), 6)).alias("cost"))


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests with their recorded response, by the digest of their canonical text: request_id, response, missing."""
    keyed = requests.select("request_id", F.sha2("canonical", 256).alias("_key"))
    return keyed.join(recorded.dropDuplicates(["key"]), F.col("_key") == F.col("key"), "left").select("request_id", "response", F.col("key").isNull().alias("missing"))


def page_layout(items: DataFrame) -> DataFrame:
    """Signals per page: page, tabular_lines, table_heavy, multi_column.  ``items``: page, line, x, width, height.

    A line with two or more gaps wider than 2.5 times the height is tabular, three such lines make a page table-heavy.
    Line starts fall into buckets of 15; two buckets of three or more lines at least 100 apart make several columns.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("page", "line").orderBy("x")
    gaps = items.withColumn("_gap", F.lead("x").over(w) - (F.col("x") + F.col("width")))
    lines = gaps.groupBy("page", "line").agg(F.count_if(F.col("_gap") > 2.5 * F.col("height")).alias("wide"), F.min("x").alias("start"))
    buckets = lines.groupBy("page", F.round(F.col("start") / 15).alias("b")).agg(F.count("*").alias("n")).where("n >= 3").groupBy("page").agg(((F.max("b") - F.min("b")) * 15 >= 100).alias("multi_column"))
    tables = lines.groupBy("page").agg(F.count_if(F.col("wide") >= 2).alias("tabular_lines"))
    return tables.join(buckets, "page", "left").select("page", "tabular_lines", (F.col("tabular_lines") >= 3).alias("table_heavy"), F.coalesce("multi_column", F.lit(False)).alias("multi_column"))
