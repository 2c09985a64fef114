"""Writing rows, blobs and reports, and checking what was written."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require

BATCH = "_batch"


def append_batch(df: DataFrame, folder: str, batch_id: str) -> DataFrame:
    """Appends the rows of one batch to a table of Parquet files, all or none; writing a batch again replaces it.

    Every batch is a partition of its own, overwritten as a whole: a failed write leaves the table as it was before, and a
    repeated one does not double its rows.  Returns the table with the column _batch.
    """
    spark = df.sparkSession
    writer = df.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BATCH).parquet(folder)
    return spark.read.parquet(folder)


def refuse_short_write(table: DataFrame, batch_id: str, expected: int) -> None:
    """Fails if a batch has another number of rows in the table than were meant to be written."""
    n = table.where(F.col(BATCH) == batch_id).count()
    if n != expected:
        raise ValueError(f"batch {batch_id}: {n} rows written, {expected} expected")


def put_blobs(blobs: DataFrame, folder: str) -> DataFrame:
    """Stores contents under their hash: blob_id, content_type, metadata, size, for each of ``blobs`` (content, content_type,
    metadata map).  Equal contents are stored once, with the first type by name.  Null contents are refused by being left out.
    """
    require(blobs, "content", "content_type", "metadata")
    named = blobs.where("content IS NOT NULL").withColumn("blob_id", F.sha2("content", 256))
    one = named.groupBy("blob_id").agg(F.min("content_type").alias("content_type"), F.first("content").alias("content"), F.first("metadata").alias("metadata"))
    append_batch(one, folder, uuid.uuid4().hex)
    return named.groupBy("blob_id").agg(F.min("content_type").alias("content_type"), F.first("metadata").alias("metadata"), F.first(F.octet_length("content")).alias("size"))


def get_blobs(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """The stored contents of ids (column blob_id): blob_id, content, content_type, metadata; unknown ids are absent."""
    return spark.read.parquet(folder).join(ids.select("blob_id").distinct(), "blob_id", "left_semi").dropDuplicates(["blob_id"]).select("blob_id", "content", "content_type", "metadata")


def delete_blobs(spark: SparkSession, folder: str, ids: DataFrame, target: str) -> DataFrame:
    """Writes the store without some ids to another folder, and returns it: files are never changed in place."""
    left = spark.read.parquet(folder).join(ids.select("blob_id").distinct(), "blob_id", "left_anti")
    left.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


#: Rows of a report; more are no report.
REPORT_ROWS = 10_000


def _cell(value) -> str:
    text = "" if value is None else f"{value:.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def markdown_report(title: str, parts: dict[str, DataFrame]) -> str:
    """A report of small results (checked bound): a heading, and a table under the name of each part."""
    lines = [f"# {title}", ""]
    for name, df in parts.items():
        rows = df.limit(REPORT_ROWS + 1).collect()
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"{name}: more than {REPORT_ROWS} rows are no report")
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
        lines += ["| " + " | ".join(_cell(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(lines)


def right_dimension(embedding: Column, dimension: int) -> Column:
    """Whether a vector has the index's dimension and only finite numbers; false for null."""
    finite = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dimension) & finite, F.lit(False))


def embed_in_batches(texts: DataFrame, provider, dimension: int, batch: int = 1000) -> DataFrame:
    """Adds ``embedding`` from a provider (list of texts -> list of vectors), asked for at most ``batch`` texts at once.

    A vector of another dimension fails the query.  Null texts get null.
    """
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(column: pa.Array) -> pa.Array:
        values = column.to_pylist()
        some = [i for i, v in enumerate(values) if v is not None]
        out = [None] * len(values)
        for begin in range(0, len(some), batch):
            part = some[begin : begin + batch]
            for i, vector in zip(part, provider([values[k] for k in part]), strict=True):
                if len(vector) != dimension:
                    raise ValueError(f"a vector of {len(vector)} numbers where {dimension} are expected")
                out[i] = vector
        return pa.array(out, pa.list_(pa.float32()))

    return texts.withColumn("embedding", embed("text"))
