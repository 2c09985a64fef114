"""Comparing where evidence was found with where it should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.text import cell_parts, quote_fold


def rectangle(address: Column) -> Column:
    """Struct (top, bottom, left, right) of a cell or range; null fields for what is no address."""
    a, b = cell_parts(F.split_part(address, F.lit(":"), F.lit(1))), cell_parts(F.when(F.contains(address, F.lit(":")), F.split_part(address, F.lit(":"), F.lit(2))).otherwise(address))
    return F.struct(F.least(a["row"], b["row"]).alias("top"), F.greatest(a["row"], b["row"]).alias("bottom"), F.least(a["column"], b["column"]).alias("left"), F.greatest(a["column"], b["column"]).alias("right"))


def expected_overlaps(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, chunk_id) of chunks that overlap a locator a case expects, once each.

    ``chunks``: chunk_id, file, kind, sheet, address, elements array<struct<index, text>>, text.  ``expected``: case_id, file, kind,
    sheet, address, index, text.  A cell overlaps a region of its sheet by rectangles.  A page, paragraph or block is looked
    for among the numbers of the chunk's elements; where a chunk has none recorded, the expected text must stand in the
    chunk (quotes, hyphens and blanks aside), and a blank text stands nowhere.  Chunks and cases meet in (file, kind).
    """
    require(chunks, "chunk_id", "file", "kind", "sheet", "address", "elements", "text")
    require(expected, "case_id", "file", "kind", "sheet", "address", "index", "text")
    e = expected.select("case_id", "file", F.when(F.col("kind") == "xlsx-cell", "xlsx-region").otherwise(F.col("kind")).alias("kind"), F.col("sheet").alias("e_sheet"), rectangle(F.col("address")).alias("e_box"), F.col("index").alias("e_index"), quote_fold(F.col("text")).alias("e_text"))
    c = chunks.select("chunk_id", "file", "kind", "sheet", rectangle(F.col("address")).alias("box"), F.transform("elements", lambda x: x["index"]).alias("indexes"), quote_fold(F.col("text")).alias("folded"))
    a, b = F.col("box"), F.col("e_box")
    cells = (F.col("sheet") == F.col("e_sheet")) & (a["top"] <= b["bottom"]) & (b["top"] <= a["bottom"]) & (a["left"] <= b["right"]) & (b["left"] <= a["right"])
    recorded = F.coalesce(F.size("indexes"), F.lit(0)) > 0
    stands = (F.col("e_text") != "") & F.contains(F.col("folded"), F.col("e_text"))
    hit = F.when(F.col("kind") == "xlsx-region", cells).when(recorded, F.array_contains("indexes", F.col("e_index"))).otherwise(stands)
    return c.join(e, ["file", "kind"]).where(hit).select("case_id", "chunk_id").distinct()


def scope_checks(values: DataFrame, overlaps: DataFrame) -> DataFrame:
    """case_id, in_scope: whether a case's conflict has values, and the chunk of each overlaps what the case expects.

    ``values``: case_id, chunk_id (null if the conflict has none).
    """
    hit = overlaps.select("case_id", "chunk_id").withColumn("_hit", F.lit(True))
    return values.join(hit, ["case_id", "chunk_id"], "left").groupBy("case_id").agg((F.bool_and(F.coalesce("_hit", F.lit(False))) & (F.count("chunk_id") > 0)).alias("in_scope"))


def citation_precision(citations: DataFrame, overlaps: DataFrame) -> DataFrame:
    """One row: n_citations, precision over all citations together; 0 if there are none.  ``citations``: case_id, chunk_id."""
    hit = overlaps.select("case_id", "chunk_id").withColumn("_hit", F.lit(1))
    return citations.join(hit, ["case_id", "chunk_id"], "left").agg(F.count("*").alias("n_citations"), F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(0.0)).alias("precision"))


def citation_index(elements: Column, quote: Column) -> Column:
    """Number of the one element that holds the quote; null (the chunk as a whole) if none or several do, or it is blank."""
    folded = quote_fold(quote)
    holding = F.filter(elements, lambda x: (folded != "") & F.contains(quote_fold(x["text"]), folded))
    return F.when(F.size(holding) == 1, F.try_element_at(holding, F.lit(1))["index"])
