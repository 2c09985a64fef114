"""Durable intermediate results in the folder all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: unlike a local checkpoint it outlives a lost executor,
and unlike an RDD checkpoint it is columnar, compressed and has statistics the optimizer reads.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_OWN: set[str] = set()


def _delete(jvm, folder: str) -> None:
    """Deletes the application's stages at the end of the driver, if its JVM still answers."""
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # the JVM is gone: nothing can be done from here
        pass


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is made only where none is set and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: this operator needs a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _FALLBACK:
        _FALLBACK[key] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _FALLBACK[key]


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    The folder belongs to the application (its id is part of the path) and is deleted when the driver's process ends; a
    driver that is killed leaves it to whoever cleans the checkpoint folder.  Column order, nullability aside, and types are kept; an empty frame stays empty with its schema.
    """
    spark = df.sparkSession
    own = f"{shared_folder(spark).rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_delete, spark.sparkContext._jvm, own)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete the files behind a frame that ``durable`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        break
