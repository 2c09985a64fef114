import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import sinks


def test_batches_are_written_once(spark, tmp_path):
    folder, rows = str(tmp_path / "t"), spark.range(10).select(F.col("id"))
    sinks.append_batch(rows, folder, "b1")
    sinks.append_batch(rows.where("id < 4"), folder, "b2")
    table = sinks.append_batch(rows.where("id < 7"), folder, "b1")
    assert {r._batch: r["count"] for r in table.groupBy("_batch").count().collect()} == {"b1": 7, "b2": 4}
    sinks.refuse_short_write(table, "b2", 4)
    with pytest.raises(ValueError, match="7 rows written"):
        sinks.refuse_short_write(table, "b1", 8)


def test_blobs(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"a"), "text/plain", {"n": "1"}), (bytearray(b"a"), "text/a", {"n": "1"}), (None, "x", None), (bytearray(b""), "e", {})], "content binary, content_type string, metadata map<string,string>")
    folder = str(tmp_path / "b")
    put = {r.size: r for r in sinks.put_blobs(df, folder).collect()}
    assert set(put) == {0, 1} and put[1].content_type == "text/a"
    ids = spark.createDataFrame([(put[1].blob_id,), ("nobody",)], "blob_id string")
    (got,) = sinks.get_blobs(spark, folder, ids).collect()
    assert bytes(got.content) == b"a" and got.metadata == {"n": "1"}
    assert sinks.delete_blobs(spark, folder, ids, str(tmp_path / "c")).count() == 1


def test_report_and_vectors(spark):
    text = sinks.markdown_report("Run", {"rates": spark.createDataFrame([("a|b", 0.5), (None, None)], "k string, v double")})
    assert text.splitlines() == ["# Run", "", "## rates", "", "| k | v |", "| --- | --- |", "| a\\|b | 0.5 |", "|  |  |"]
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), (None,), ([None, 1.0],)], "embedding array<double>")
    assert [r.ok for r in v.select(sinks.right_dimension(F.col("embedding"), 2).alias("ok")).collect()] == [True, False, False, False, False]
    t = spark.createDataFrame([("ab",), (None,), ("",)], "text string")
    asked = lambda texts: [[float(len(x)), 0.0] for x in texts]
    assert [r.embedding for r in sinks.embed_in_batches(t, asked, 2, 1).collect()] == [[2.0, 0.0], None, [0.0, 0.0]]
    with pytest.raises(Exception, match="are expected"):
        sinks.embed_in_batches(t, asked, 3).collect()
