"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of ``folder``; zone-less timestamps become UTC instants, so both kinds compare alike."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.select(*[F.col(f"`{c}`").cast("timestamp").alias(c) if c in naive else F.col(f"`{c}`") for c in df.columns]) if naive else df


def scoped(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Only one tenant's rows.  Applied at the scan, so the predicate reaches the Parquet reader; None means no predicate."""
    return df if tenant is None else df.where(F.col(column) == F.lit(tenant))


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, with a plain message, if a column an operator needs is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; got {', '.join(df.columns)}")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)
