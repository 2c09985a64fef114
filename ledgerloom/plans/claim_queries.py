"""Queries over claims, quotes, questions, chunks and sheets.

Claims are derived from the evaluation items (what they state) and the documents they may be quoted from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import table
from ledgerloom.functions.claims import content_tokens_column, locate_quote_column, numbers_column, quote_alignment_column
from ledgerloom.functions.text import entity_fold
from ledgerloom.operators.chunking import chunk_documents, chunk_id
from ledgerloom.operators.documents import content_hash
from ledgerloom.operators.gate import check_claims, grounding_report
from ledgerloom.operators.ledger import measure_aliases
from ledgerloom.operators.questions import resolve_questions
from ledgerloom.operators.retrieval import lexical_search
from ledgerloom.operators.sheets import header_proposals, header_rows, region_of_cell, sheet_facts
from ledgerloom.plans.retrieval_queries import quotes_in_documents
from ledgerloom.sources.files import parse_files


def _first_sentence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select("item_id", "case_id", "category", "question", F.regexp_extract("text", r"^(.*?[.])(?: [A-Z]|$)", 1).alias("statement"), "text")


def _best_documents(spark: SparkSession, folder: str) -> DataFrame:
    items = _first_sentence(spark, folder).select(F.col("item_id").alias("query_id"), F.col("statement").alias("text"))
    return lexical_search(table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "text"), items, 2).select(F.col("query_id").alias("claim_id"), F.col("item_id").alias("doc_id"), "rank")


def quote_locate(spark: SparkSession, folder: str) -> DataFrame:
    """How the first sentence of each evaluation item stands in documents: exactly in any of them, or nearly in the two that
    are nearest to it by words.
    """
    exact = quotes_in_documents(spark, folder).select(F.col("item_id").alias("claim_id"), "doc_id", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))
    best = _best_documents(spark, folder).join(_first_sentence(spark, folder).select(F.col("item_id").alias("claim_id"), "statement"), "claim_id").join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    near = best.withColumn("at", locate_quote_column("statement", "text")).where("at.kind <> 'exact'")
    return exact.unionByName(near.select("claim_id", "doc_id", F.col("at.kind").alias("kind"), F.round("at.similarity", 4).alias("similarity")))


def quote_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each evaluation passage carries its question."""
    e = table(spark, folder, "eval_items")
    return e.select("item_id", quote_alignment_column("question", F.array("text")).alias("verdict"))


def content_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Content tokens of every evaluation passage, and how many its question shares."""
    e = table(spark, folder, "eval_items").select("item_id", content_tokens_column("text").alias("a"), content_tokens_column("question").alias("b"))
    return e.select("item_id", F.size("a").alias("n_tokens"), F.size(F.array_intersect("a", "b")).alias("n_shared"))


def atom_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the sentences of a passage, as atoms, cover it exactly, and what is left over on both sides."""
    e = table(spark, folder, "eval_items").select("item_id", "text", F.split("text", r"(?<=[.]) ").alias("atoms"))
    whole = e.select("item_id", content_tokens_column("text").alias("own"))
    parts = e.select("item_id", F.explode("atoms").alias("atom")).select("item_id", F.explode(content_tokens_column("atom")).alias("t")).groupBy("item_id").agg(F.collect_set("t").alias("parts"))
    j = whole.join(parts, "item_id")
    return j.select("item_id", F.size(F.array_except("own", "parts")).alias("n_uncovered"), F.size(F.array_except("parts", "own")).alias("n_extraneous"))


def spelled_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in words and digits of literal texts."""
    literal = ["twenty five tenants", "one tenant", "a hundred suites", "two hundred three million and $5.5", "(1,250) and 12%", "three point one four", "zero", "nothing here"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(literal)], "n int, text string")
    return t.select("n", F.array_join(F.transform(numbers_column("text"), lambda v: F.round(v, 3).cast("string")), ",").alias("numbers"))


def claim_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of claims that quote the document nearest to them."""
    claims = _first_sentence(spark, folder).select(F.col("item_id").alias("claim_id"), "statement")
    best = _best_documents(spark, folder).where("rank = 1")
    citations = best.join(claims, "claim_id").select("claim_id", F.col("doc_id").alias("chunk_id"), F.col("statement").alias("quote"))
    chunks = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    none = spark.createDataFrame([], "chunk_id bigint, amount double")
    return check_claims(claims, citations, chunks, none)


def answers_report(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage and outcome per evaluation category, from the gate."""
    claims = table(spark, folder, "eval_items").select(F.col("item_id").alias("claim_id"), F.col("category").alias("answer_id"), (F.col("item_id") % 50 == 0).alias("conflicted"))
    return grounding_report(claim_gate(spark, folder), claims)


def question_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """What each evaluation question, and a few literal ones, ask about."""
    literal = spark.createDataFrame([(-1, "What is the site area of Quelfimere Tower in Q3 2022?"), (-2, "What is the site area?"), (-3, "Is the npi of Quelfimere Tower above 5000?"), (-4, "Compare exit yield and npi of Quelfimere Tower"), (-5, "npi of Quelfimere Tower for 2021 and 2022")], "question_id bigint, question string")
    questions = table(spark, folder, "eval_items").select(F.col("item_id").alias("question_id"), "question").unionByName(literal)
    names = table(spark, folder, "ledger_resolutions").select(entity_fold(F.col("entity")).alias("key")).where("key <> ''").distinct()
    measures = measure_aliases(table(spark, folder, "measure_defs")).select(F.col("slug").alias("key"), F.col("alias").alias("phrase")).where("phrase <> key")
    return resolve_questions(questions, names.withColumn("phrase", F.col("key")), measures)


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents with their identity."""
    d = table(spark, folder, "documents").select("doc_id", "tenant_id", content_hash(F.col("text")).alias("sha"))
    c = chunk_documents(table(spark, folder, "documents")).join(d, "doc_id")
    return c.select("doc_id", "ordinal", "n_tokens", "first_block", F.length("text").alias("n_chars"), chunk_id(F.col("tenant_id"), F.col("sha"), F.col("ordinal"), "1", F.col("first_block").cast("string")).alias("chunk_id"))


def document_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks between blank lines of every document, through the text parser."""
    files = table(spark, folder, "documents").select(F.col("doc_id").alias("file_id"), F.lit("txt").alias("kind"), F.encode("text", "UTF-8").alias("content"))
    return parse_files(files).groupBy("file_id").agg(F.count("block_index").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet per source with its facts, written as CSV and parsed again."""
    f = table(spark, folder, "facts").select("source_id", "fact_id", F.coalesce("entity", F.lit("")).alias("e"), F.coalesce("period_text", F.lit("")).alias("p"), F.coalesce(F.col("amount").cast("decimal(20,4)").cast("string"), F.lit("")).alias("v")).distinct()
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", quoted("e"), quoted("p"), "v", "v")
    # One file per source and hundred facts: no file gathers a whole source.
    files = f.groupBy("source_id", F.pmod(F.crc32("fact_id"), F.lit(8)).alias("part")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    content = F.encode(F.concat(F.lit("Property Name,Period,NPI,Stalls (%)\n"), "body"), "UTF-8")
    parsed = parse_files(files.select(F.concat_ws("-", "source_id", "part").alias("file_id"), F.lit("csv").alias("kind"), content.alias("content")))
    a = F.col("cell")
    return parsed.select(F.col("file_id").alias("sheet_id"), F.regexp_extract(a, r"(\d+)$", 1).cast("int").alias("row"), (F.ascii(F.substring(a, 1, 1)) - 64).alias("column"), "text")


def header_detect(spark: SparkSession, folder: str) -> DataFrame:
    """The header row of each sheet."""
    return header_rows(_cells(spark, folder))


def proposed_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric columns that could be measures."""
    return header_proposals(_cells(spark, folder))


def tabular_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts read from the sheets, per measure and unit."""
    aliases = measure_aliases(table(spark, folder, "measure_defs")).join(table(spark, folder, "measure_defs").select("slug", "value_type").distinct(), "slug")
    return sheet_facts(_cells(spark, folder), aliases).groupBy("slug", "unit", "reason").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("n_entities"))


def cell_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Cells per chunk of four rows."""
    cells = _cells(spark, folder)
    regions = cells.where("row > 1").groupBy("sheet_id", F.floor((F.col("row") - 2) / 4).alias("w")).agg(F.min("row").alias("first_row"), F.max("row").alias("last_row")).select("sheet_id", "first_row", "last_row", F.col("w").alias("ordinal"), F.concat_ws("#", "sheet_id", "w").alias("chunk_id"))
    return region_of_cell(cells, regions).groupBy("chunk_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (quote_locate, quote_alignment, content_token_counts, atom_coverage, spelled_numbers, claim_gate, answers_report, question_resolution, document_chunks, document_blocks, header_detect, proposed_measures, tabular_facts, cell_regions)}

ORACLE = {
    "spelled_numbers": "SELECT * FROM (VALUES (0, '25.0'), (1, ''), (2, ''), (3, '2.03E8,5.5'), (4, '-1250.0,12.0'), (5, '3.14'), (6, '0.0'), (7, '')) t(n, numbers)",
}
