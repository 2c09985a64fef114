"""Queries of the smaller report operators, over literal rows and the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import table
from ledgerloom.operators.reports import canary_leaks, contains_expected, overlapping_ranges, page_layout, replay, select_filings, token_costs


def selected_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Annual and quarterly filings of 2024, newest first, annual before quarterly."""
    s = spark.createDataFrame([(1, ["a", "b", "c", "d"], ["10-K", "10-Q", "8-K", "10-Q"], ["2024-03-01", "2024-05-01", "2024-06-01", "2023-11-01"]), (2, ["e"], ["10-Q"], ["2024-12-31"])], "cik bigint, accession array<string>, form array<string>, filed array<string>")
    return select_filings(s, ["10-K", "10-Q"], "2024-01-01", "2024-12-31").orderBy(F.col("filed").desc(), F.col("form"), "accession")


def rectangle_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of a sheet that share a cell."""
    r = spark.createDataFrame([("s", "A1:C4"), ("s", "C4:D9"), ("s", "E1"), ("s", "AA10:AB90"), ("s", "AB33"), ("t", "A1"), ("s", "bad")], "sheet string, address string")
    return overlapping_ranges(r)


def answer_content(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that hold their first amount whole, and cut short by its last digit."""
    e = table(spark, folder, "eval_items").withColumn("amount", F.regexp_extract("text", r"\$([\d.,]*\d)", 1)).where("amount <> ''")
    whole, cut = F.array("amount"), F.array(F.expr("left(amount, length(amount) - 1)"))
    return e.select("item_id", contains_expected(F.col("text"), whole).alias("whole"), F.when(F.try_element_at(cut, F.lit(1)).rlike(r"\d$"), contains_expected(F.col("amount"), cut)).alias("cut"))


def canaries(spark: SparkSession, folder: str) -> DataFrame:
    """Two words as canaries in the evaluation passages; the first sentence counts as a verified quote."""
    e = table(spark, folder, "eval_items").select("case_id", "text", F.array(F.regexp_extract("text", r"^(.*?[.])(?: [A-Z]|$)", 1)).alias("quotes"))
    return canary_leaks(e, ["square feet", "escrow"])


def model_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Cost of events taken as calls of three models, one of them without a price."""
    usage = table(spark, folder, "events").select(F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 70).alias("output_tokens"))
    return token_costs(usage, spark.createDataFrame([("m0", 3.0, 15.0), ("m1", 0.25, 1.25)], "model string, input_per_million double, output_per_million double"))


def replayed_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Questions replayed from recorded responses; those not recorded are marked."""
    e = table(spark, folder, "eval_items")
    recorded = e.where("item_id % 4 <> 0").select(F.sha2("question", 256).alias("key"), F.md5("text").alias("response"))
    return replay(e.select(F.col("item_id").alias("request_id"), F.col("question").alias("canonical")), recorded).groupBy("missing").agg(F.count("*").alias("n"))


def layout_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of two drawn pages: a table, and two columns of text."""
    rows = [(1, n, float(x), 20.0, 10.0) for n in range(4) for x in (0, 100, 200)] + [(2, n, 0.0 if n % 2 else 300.0, 200.0, 10.0) for n in range(8)]
    return page_layout(spark.createDataFrame(rows, "page int, line int, x double, width double, height double"))


QUERIES = {f.__name__: f for f in (selected_filings, rectangle_overlaps, answer_content, canaries, model_costs, replayed_requests, layout_signals)}

_QUOTE = r"regexp_extract(text, '^(.*?[.])(?: [A-Z]|$)', 1)"

ORACLE = {
    "selected_filings": "SELECT * FROM (VALUES (1, 'a', '10-K', '2024-03-01'), (1, 'b', '10-Q', '2024-05-01'), (2, 'e', '10-Q', '2024-12-31')) t(cik, accession, form, filed)",
    "rectangle_overlaps": "SELECT * FROM (VALUES ('s', 'A1:C4', 'C4:D9'), ('s', 'AA10:AB90', 'AB33')) t(sheet, a, b)",
    "answer_content": r"WITH e AS (SELECT item_id, regexp_extract(text, '\$([\d.,]*\d)', 1) AS amount FROM eval_items) SELECT item_id, true AS whole, CASE WHEN regexp_matches(amount[:-2], '\d$') THEN false END AS cut FROM e WHERE amount <> ''",
    "canaries": f"WITH e AS (SELECT case_id, text, {_QUOTE} AS q, unnest(['square feet', 'escrow']) AS token FROM eval_items), c AS (SELECT case_id, token, ((length(text) - length(replace(text, token, ''))) / length(token))::INT AS n_total, ((length(q) - length(replace(q, token, ''))) / length(token))::INT AS n_quoted FROM e) SELECT *, n_total > n_quoted AS own_voice FROM c",
    "model_costs": "WITH u AS (SELECT 'm' || (event_id % 3)::VARCHAR AS model, event_id % 1000 AS i, event_id % 70 AS o FROM events), p AS (SELECT * FROM (VALUES ('m0', 3.0::DOUBLE, 15.0::DOUBLE), ('m1', 0.25, 1.25)) t(model, a, b)) SELECT model, count(*) AS n_calls, round(sum((i * a + o * b) / 1000000), 6) AS cost FROM u LEFT JOIN p USING (model) GROUP BY 1",
    "replayed_requests": "WITH r AS (SELECT DISTINCT sha256(question) AS key FROM eval_items WHERE item_id % 4 <> 0) SELECT sha256(question) NOT IN (SELECT key FROM r) AS missing, count(*) AS n FROM eval_items GROUP BY 1",
    "layout_signals": "SELECT * FROM (VALUES (1, 4, true, false), (2, 0, false, true)) t(page, tabular_lines, table_heavy, multi_column)",
}
