"""Facts from sheets: header rows, what columns measure, and the values of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.text import alias_key, header_base, header_unit, measure_slug

# Headers of the columns that name the entity and the period.
ENTITY_HEADERS = ("property name", "entity", "asset name", "property")
PERIOD_HEADERS = ("sale date", "date", "period", "transaction date")
NUMERIC_CELL = r"^-?\$?\d[\d,]*(?:\.\d+)?%?$"
SCANNED_ROWS = 10


def header_rows(cells: DataFrame) -> DataFrame:
    """sheet_id, header_row, qualified.  ``cells``: sheet_id, row, column, text.

    The first of the first ten occupied rows with two or more, not all equal, filled cells and a row after it; else the first.
    """
    require(cells, "sheet_id", "row", "column", "text")
    filled = F.when(F.trim("text") != "", F.col("text"))
    rows = cells.groupBy("sheet_id", "row").agg(F.count(filled).alias("n"), F.countDistinct(filled).alias("n_distinct"))
    w = Window.partitionBy("sheet_id").orderBy("row")
    ranked = rows.withColumn("_at", F.row_number().over(w)).withColumn("_after", F.lead("row").over(w))
    good = (F.col("_at") <= SCANNED_ROWS) & (F.col("n") >= 2) & (F.col("n_distinct") >= 2) & F.col("_after").isNotNull()
    return ranked.groupBy("sheet_id").agg(F.min(F.when(good, F.col("row"))).alias("_good"), F.min("row").alias("_first")).select("sheet_id", F.coalesce("_good", "_first").alias("header_row"), F.col("_good").isNotNull().alias("qualified"))


def value_type(header: Column, all_percent: Column, all_dollar: Column) -> Column:
    """percentage, currency, area, duration or count, from words of the header, else from what all cells look like."""
    h = F.lower(header)
    return (
        F.when(h.rlike(r"%|\bpercent\b|\bpct\b"), "percentage").when(h.rlike(r"\$|\busd\b"), "currency").when(h.rlike(r"\bsf\b|\bsq ft\b|\bsqft\b|\bsquare feet\b"), "area")
        .when(h.rlike(r"\byears\b|\byrs\b|\bmonths\b"), "duration").when(all_percent, "percentage").when(all_dollar, "currency").otherwise("count")
    )


def header_proposals(cells: DataFrame) -> DataFrame:
    """Columns that could be new measures: sheet_id, column, header, slug, value_type.

    All filled cells below the header must be numbers, at least one, and the header must give a slug.
    """
    data, heads = _below_headers(cells)
    t = F.trim("text")
    sums = data.where(t != "").groupBy("sheet_id", "column").agg(F.bool_and(t.rlike(NUMERIC_CELL)).alias("numeric"), F.bool_and(t.endswith("%")).alias("percent"), F.bool_and(t.startswith("$")).alias("dollar"))
    named = sums.where("numeric").join(heads, ["sheet_id", "column"])
    return named.withColumn("slug", measure_slug(F.col("header"))).where("slug IS NOT NULL").select("sheet_id", "column", "header", "slug", value_type(F.col("header"), F.col("percent"), F.col("dollar")).alias("value_type"))


def _below_headers(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    placed = cells.join(header_rows(cells).select("sheet_id", "header_row"), "sheet_id")
    heads = placed.where("row = header_row").select("sheet_id", "column", F.col("text").alias("header"))
    return placed.where("row > header_row").select("sheet_id", "row", "column", "text"), heads


def display_amount(text: Column, kind: Column, unit_hint: Column) -> Column:
    """Struct (amount, unit, reason) of a displayed value of a kind: currency, percentage or another.

    Currency may have $, commas and a suffix for thousands or millions; a percentage is in percent if it shows % or the
    header says so, else a ratio.  Anything else that is no plain number is refused with a reason.
    """
    bare = F.trim(F.regexp_replace(text, r"[$,]", ""))
    number = F.regexp_extract(bare, r"^(-?\d+(?:\.\d+)?)\s*([a-zA-Z]*)$", 1)
    suffix = F.lower(F.regexp_extract(bare, r"^(-?\d+(?:\.\d+)?)\s*([a-zA-Z]*)$", 2))
    money_unit = F.when(suffix == "", "usd").when(suffix.isin("k", "thousand"), "usd_thousands").when(suffix.isin("m", "mm", "million"), "usd_millions")
    share = F.regexp_extract(F.regexp_replace(F.trim(text), ",", ""), r"^(-?\d+(?:\.\d+)?)\s*%?$", 1)
    share_unit = F.when(text.contains("%") | (unit_hint == "percent"), "percent").otherwise("ratio")
    plain = F.regexp_extract(F.regexp_replace(F.trim(text), ",", ""), r"^(-?\d+(?:\.\d+)?)$", 1)
    raw = F.when(kind == "currency", number).when(kind == "percentage", share).otherwise(plain)
    unit = F.when(kind == "currency", money_unit).when(kind == "percentage", share_unit).otherwise("base")
    amount = F.when((raw != "") & unit.isNotNull(), raw.try_cast("double"))
    safe = F.abs(amount) <= 9007199254740991.0
    return F.struct(F.when(safe, amount).alias("amount"), F.when(safe, unit).alias("unit"), F.when(~F.coalesce(safe, F.lit(False)), F.when(raw == "", "not-a-number").when(unit.isNull(), "unknown-suffix").otherwise("out-of-range")).alias("reason"))


def sheet_facts(cells: DataFrame, aliases: DataFrame) -> DataFrame:
    """One candidate fact per cell under a header that names a measure: sheet_id, row, column, entity, period_text, slug,
    amount, unit, reason.

    ``aliases``: alias (folded), slug, value_type.  A header matches whole, without its unit mark, or by its slug.  Rows
    without entity keep a null one.
    """
    data, heads = _below_headers(cells)
    key = alias_key(F.col("header"))
    role = F.when(key.isin(*ENTITY_HEADERS), "entity").when(key.isin(*PERIOD_HEADERS), "period")
    marked = heads.withColumn("role", role).withColumn("hint", header_unit(F.col("header"))).withColumn("_keys", F.array_distinct(F.array(key, alias_key(header_base(F.col("header"))), F.coalesce(measure_slug(F.col("header")), F.lit("")))))
    measured = marked.where("role IS NULL").select("sheet_id", "column", "hint", F.posexplode("_keys").alias("_n", "alias")).join(aliases, "alias").groupBy("sheet_id", "column", "hint").agg(F.min(F.struct("_n", "slug", "value_type")).alias("m"))
    sides = data.join(marked.where("role IS NOT NULL").select("sheet_id", "column", "role"), ["sheet_id", "column"])
    keys = sides.groupBy("sheet_id", "row").agg(F.min_by(F.when(F.col("role") == "entity", F.col("text")), F.when(F.col("role") == "entity", F.col("column"))).alias("entity"), F.min_by(F.when(F.col("role") == "period", F.col("text")), F.when(F.col("role") == "period", F.col("column"))).alias("period_text"))
    values = data.where(F.trim("text") != "").join(measured, ["sheet_id", "column"]).withColumn("v", display_amount(F.col("text"), F.col("m.value_type"), F.col("hint")))
    return values.join(keys, ["sheet_id", "row"], "left").select("sheet_id", "row", "column", "entity", "period_text", F.col("m.slug").alias("slug"), "v.amount", "v.unit", "v.reason")


def region_of_cell(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """The first region that holds each cell: cell columns and chunk_id (null if none does).

    ``cells``: sheet_id, row, column, ...; ``regions``: sheet_id, first_row, last_row, ordinal, chunk_id.  The range join is
    an equi join on row blocks: a region is listed under every block of rows it touches.
    """
    block = 64
    spread = regions.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first_row") / block), F.floor(F.col("last_row") / block))))
    at = cells.withColumn("_block", F.floor(F.col("row") / block))
    hit = at.join(spread, ["sheet_id", "_block"]).where("row BETWEEN first_row AND last_row").groupBy("sheet_id", "row", "column").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id"))
    return cells.join(hit, ["sheet_id", "row", "column"], "left")


def rectangles_overlap(a: Column, b: Column) -> Column:
    """Whether two structs (top, left, bottom, right) share a cell."""
    return (a["top"] <= b["bottom"]) & (b["top"] <= a["bottom"]) & (a["left"] <= b["right"]) & (b["left"] <= a["right"])
