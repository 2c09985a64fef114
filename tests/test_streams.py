from datetime import datetime

from ledgerloom.plans.stream_queries import file_changes_stream

FILES = "source_id bigint, sweep_no int, delivery_no int, path string, sha256 string, withdrawn_at timestamp"
SWEEPS = "source_id bigint, sweep_no int, delivery_no int, file_count bigint"


def test_file_changes_follow_the_highest_complete_delivery(spark, tmp_path):
    gone = datetime(2024, 1, 1)
    f = [(1, 1, 1, "a", "1", None), (1, 1, 2, "a", "1", None), (1, 1, 2, "./b", "2", None),  # the second is complete
         (1, 2, 1, "a", "9", None),  # never complete: passed over
         (1, 3, 1, "a", "1", None), (1, 3, 1, "b", "3", None), (1, 3, 2, "a", "8", None),  # the second is incomplete
         (1, 4, 1, "a", "1", None), (1, 4, 1, "b", "3", None), (1, 4, 2, "a", "1", gone), (1, 4, 2, "b", "3", None), (1, 4, 2, "b", "3", None)]
    s = [(1, 1, 1, 2), (1, 1, 2, 2), (1, 2, 1, 2), (1, 3, 1, 2), (1, 3, 2, 2), (1, 4, 1, 2), (1, 4, 2, 2)]
    spark.createDataFrame(f, FILES).write.parquet(str(tmp_path / "file_states.parquet"))
    spark.createDataFrame(s, SWEEPS).write.parquet(str(tmp_path / "source_sweeps.parquet"))
    got = {(r.source_id, r.change_kind): r.n for r in file_changes_stream(spark, str(tmp_path)).collect()}
    assert got == {(1, "added"): 2, (1, "changed"): 1, (1, "removed"): 1}
