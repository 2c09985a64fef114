"""Projections, filters and orders of listings, and set operations on ids."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require

#: An id list up to this length is a predicate that reaches the scan; a longer one is a table to join with.
FEW_IDS = 1000


def pick_fields(df: DataFrame, selected: str | None, key: str) -> DataFrame:
    """The columns a comma list names, and always the key; unknown names are ignored, a blank list means all columns."""
    require(df, key)
    names = [n.strip() for n in (selected or "").split(",") if n.strip()]
    return df.select(key, *[n for n in dict.fromkeys(names) if n in df.columns and n != key]) if names else df


def whitelisted(df: DataFrame, declared: Iterable[str]) -> DataFrame:
    """Only the declared columns, in their order; those the frame lacks are null strings."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in declared])


def without(df: DataFrame, *columns: str) -> DataFrame:
    """All columns but these; absent ones are no error."""
    return df.drop(*columns)


def with_ids(df: DataFrame, column: str, ids: list | DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the ids: a predicate for a short list, a semi join for a frame (its first column)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct(), column, "left_semi")
    if len(ids) > FEW_IDS:
        raise ValueError(f"more than {FEW_IDS} ids: give them as a frame")
    return df.where(F.col(column).isin(ids))


def under_entity(group_key: Column, entity: Column) -> Column:
    """Whether a cell's composite key begins with an entity (already folded); special characters have no meaning."""
    return F.startswith(group_key, F.concat(entity, F.lit("::")))


def has_location(locations: Column, path: Column, source_id: Column) -> Column:
    """Whether an array of (path, source_id) holds a location; a null source is a value of its own.  Null arrays hold none."""
    return F.coalesce(F.exists(locations, lambda x: (x["path"] == path) & x["source_id"].eqNullSafe(source_id)), F.lit(False))


def within_ceiling(spent: Column, reserved: Column, asked: Column, ceiling: Column) -> Column:
    """Whether a further amount stays within the ceiling, what is reserved counted as spent; no ceiling means always."""
    return F.coalesce(F.coalesce(spent, F.lit(0)) + F.coalesce(reserved, F.lit(0)) + asked <= ceiling, F.lit(True))


def sorted_by(df: DataFrame, sort: str | None, direction: str | None, allowed: tuple[str, ...], default: str, key: str) -> DataFrame:
    """Sorted by an allowed column (else the default one), ascending unless ``direction`` is 'desc', ties by key."""
    column = F.col(sort if sort in allowed else default)
    return df.orderBy(column.desc_nulls_last() if direction == "desc" else column.asc_nulls_first(), key)


def locator_order(kind: Column, index: Column, address: Column) -> Column:
    """Sort key of a locator: its kind, and its index padded by zeros; cells and ranges as they are written (A10 before A2)."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("xlsx-region", "xlsx-cell"), address).otherwise(F.lpad(index.cast("string"), 10, "0")))


def appended(values: Column, value: Column) -> Column:
    """An array with a value that it did not hold; a null value changes nothing, a null array is empty."""
    held = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(value.isNull(), held).otherwise(F.array_union(held, F.array(value)))


def candidates_of(accepted: DataFrame, proposed: DataFrame) -> DataFrame:
    """Accepted and proposed candidates in one frame, marked by ``origin``; columns only one side has are null."""
    return accepted.withColumn("origin", F.lit("accepted")).unionByName(proposed.withColumn("origin", F.lit("proposed")), allowMissingColumns=True)


def missing_ids(expected: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """Ids that are expected and not present, once each; null ids are none."""
    return expected.select(column).where(F.col(column).isNotNull()).distinct().join(present.select(column), column, "left_anti")


def refuse_missing(expected: DataFrame, present: DataFrame, column: str) -> None:
    """Fails, naming up to five of them, if ids are missing."""
    some = [r[0] for r in missing_ids(expected, present, column).orderBy(column).limit(5).collect()]
    if some:
        raise ValueError(f"{column} without a row: {', '.join(map(str, some))}")


def flattened(answers: DataFrame) -> DataFrame:
    """answers(answer_id, claims array<struct<claim_id, citations array<string>>>) as one row per citation: answer_id,
    claim_id, citation.  Answers without claims, and claims without citations, have none.
    """
    claims = answers.select("answer_id", F.explode("claims").alias("c"))
    return claims.select("answer_id", F.col("c.claim_id").alias("claim_id"), F.explode("c.citations").alias("citation"))


def _numbers(fields: list[T.StructField], prefix: str, excluded: tuple[str, ...]) -> Iterator[str]:
    for f in fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if path in excluded or any(e.endswith(".") and path.startswith(e) for e in excluded):
            continue
        if isinstance(f.dataType, T.StructType):
            yield from _numbers(f.dataType.fields, path, excluded)
        elif isinstance(f.dataType, T.NumericType):
            yield path


def flat_metrics(metrics: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Nested numbers under dotted names: metric, value.  Excluded are whole paths, or with a point at the end all below;
    null, infinite and NaN values are dropped.
    """
    paths = list(_numbers(metrics.schema.fields, "", excluded))
    if not paths:
        return metrics.sparkSession.createDataFrame([], "metric string, value double")
    pairs = F.array(*[F.struct(F.lit(p).alias("metric"), F.col(p).cast("double").alias("value")) for p in paths])
    rows = metrics.select(F.explode(pairs).alias("x")).select("x.*")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & ~F.col("value").isin(math.inf, -math.inf))
