"""Streams over the tables' folder, and running them to a finished table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.storage import shared_folder


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files; zone-less timestamps become UTC instants, so that they can carry a watermark."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parque[t]")
    naive = {f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return stream.select(*[F.col(c).cast("timestamp").alias(c) if c in naive else F.col(c) for c in stream.columns])


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is now, and return what it wrote.

    Every batch is written under its own number, so that a batch that is repeated after a failure overwrites itself.  In
    complete mode the last batch is the result; in update mode the last row of each of ``keys``; in append mode all rows.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/{number:09d}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(write).start()
    query.awaitTermination()
    out = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/out").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/out")):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(out).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_last"))
        return rows.join(F.broadcast(last), F.col("_batch") == F.col("_last")).drop("_batch", "_last")  # one row
    if mode == "update":
        return rows.groupBy(*(keys or [])).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in (keys or [])]), "_batch").alias("_v")).select(*(keys or []), "_v.*")
    return rows.drop("_batch")
