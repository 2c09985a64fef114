import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators.documents import corpus_fingerprint, duplicate_documents, members_of, most_concurrent, prune_conflicts, sweep_withdrawals, within_budget
from ledgerloom.operators.evaluation import compare_to_baseline, retrieval_quality
from ledgerloom.operators.retrieval import fuse_ranks, lexical_search, vector_search
from ledgerloom.operators.sheets import display_amount, header_rows, region_of_cell


def test_vectors_against_numpy_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 4))
    rows = [(i, m[i].tolist()) for i in range(60)] + [(60, None), (61, [1.0]), (62, [0.0] * 4), (63, [None, 1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "item_id bigint, embedding array<double>")
    got = vector_search(v, v.where("item_id < 3"), 5, 4).orderBy("query_id", "rank").collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(3):
        want = sorted(range(60), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:5]
        assert [r.item_id for r in got if r.query_id == q] == want
    assert vector_search(v.limit(0), v.limit(0), 5, 4).count() == 0


def test_lexical_and_fused_ranks(spark):
    t = spark.createDataFrame([(1, "red tower"), (2, "red red house"), (3, None), (4, ""), (5, "a blue house")], "item_id bigint, text string")
    q = spark.createDataFrame([(9, "Red, red HOUSE"), (8, None)], "query_id bigint, text string")
    hits = lexical_search(t, q, 10)
    assert [(r.item_id, r.rank) for r in hits.orderBy("rank").collect()] == [(2, 1), (5, 2), (1, 3)] or [r.item_id for r in hits.orderBy("rank").collect()][0] == 2
    other = spark.createDataFrame([(9, 5, 1), (9, 7, 2)], "query_id bigint, item_id bigint, rank int")
    fused = {r.item_id: (r.lexical_rank, r.vector_rank) for r in fuse_ranks(hits, other, 10).collect()}
    assert fused[7] == (None, 2) and fused[5][1] == 1 and fused[2][1] is None


def test_quality_and_baseline(spark):
    h = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, None), ("c", 7, True)], "case_id string, rank int, overlap boolean")
    r = retrieval_quality(h).first()
    assert (r.n_cases, round(r.recall_at_5, 3), round(r.recall_at_10, 3), round(r.mrr, 4)) == (3, 0.333, 0.667, round((0.5 + 1 / 7) / 3, 4))
    c = compare_to_baseline(spark.createDataFrame([("x", 1.0), ("n", 1.0)], "metric string, value double"), spark.createDataFrame([("x", 2.0, True), ("y", 1.0, True)], "metric string, value double, higher_is_better boolean"))
    assert {r.metric: r.status for r in c.collect()} == {"x": "regressed", "n": "new", "y": "missing"}


def test_documents(spark):
    d = spark.createDataFrame([(1, "t", "x", 2), (2, "t", "x", 1), (3, "u", "x", 1), (4, "t", None, 1)], "doc_id bigint, tenant_id string, text string, i int").withColumn("ingested_at", F.timestamp_seconds("i"))
    assert sorted((r.tenant_id, r.kept_id, r.n_copies) for r in duplicate_documents(d).collect()) == [("t", 2, 2), ("u", 3, 1)]
    a, b = corpus_fingerprint(d, "doc_id").first(), corpus_fingerprint(d.union(d).repartition(3), "doc_id").first()
    assert a == b and a.n == 4 and corpus_fingerprint(d.where("doc_id < 4"), "doc_id").first().fingerprint != a.fingerprint
    c = spark.createDataFrame([("1", ["a", "b"], "open", None), ("2", ["a", "b", "c"], "open", None), ("3", None, "open", None)], "conflict_id string, fact_ids array<string>, status string, outcome string")
    gone = spark.createDataFrame([("a",)], "fact_id string")
    assert sorted((r.conflict_id, r.fact_ids, r.status, r.outcome) for r in prune_conflicts(c, gone).collect()) == [("1", ["b"], "resolved", "superseded"), ("2", ["b", "c"], "open", None), ("3", [], "open", None)]
    assert {r.conflict_id: (r.n_members, r.n_found) for r in members_of(c, gone).collect()} == {"1": (2, 1), "2": (3, 1), "3": (0, 0)}
    w = spark.createDataFrame([("s", 1, 5), ("s", 2, None), ("s", 3, 6), ("s", 4, 1)], "s string, o int, n int")
    assert [r.o for r in within_budget(w, ["s"], ["o"], "n", 10).orderBy("o").collect()] == [1, 2]
    e = spark.createDataFrame([("u", 1, 3), ("u", 2, 4), ("u", 3, 5)], "u string, a int, b int")
    assert most_concurrent(e, "u", "a", "b").first().most == 2


def test_withdrawals(spark):
    sweeps = spark.createDataFrame([(1, n) for n in range(1, 6)], "source_id bigint, sweep_no int")
    listed = [(1, n, p) for n, ps in {1: "abcd", 2: "abc", 3: "abc", 4: "a", 5: "abc"}.items() for p in ps]  # sweep 4 lacks too much
    assert [tuple(r) for r in sweep_withdrawals(spark.createDataFrame(listed, "source_id bigint, sweep_no int, path string"), sweeps).collect()] == [(1, "d", 3)]


def test_sheets(spark):
    c = spark.createDataFrame([("s", 1, 1, "Title"), ("s", 2, 1, "Property"), ("s", 2, 2, "NOI"), ("s", 3, 1, "A"), ("t", 4, 1, "x"), ("t", 5, 1, " ")], "sheet_id string, row int, column int, text string")
    assert {r.sheet_id: (r.header_row, r.qualified) for r in header_rows(c).collect()} == {"s": (2, True), "t": (4, False)}
    v = spark.createDataFrame([("$1.5 MM", "currency", None), ("5.25%", "percentage", None), ("0.05", "percentage", "percent"), ("1,200", "count", None), ("12 zz", "currency", None), ("n/a", "count", None), (None, "count", None)], "text string, kind string, hint string")
    got = v.select(display_amount(F.col("text"), F.col("kind"), F.col("hint")).alias("v")).collect()
    assert [(r.v.amount, r.v.unit) for r in got] == [(1.5, "usd_millions"), (5.25, "percent"), (0.05, "percent"), (1200.0, "base"), (None, None), (None, None), (None, None)]
    regions = spark.createDataFrame([("s", 1, 100, 1, "big"), ("s", 2, 3, 0, "first")], "sheet_id string, first_row int, last_row int, ordinal int, chunk_id string")
    assert {r.row: r.chunk_id for r in region_of_cell(c.where("sheet_id = 's'"), regions).collect()} == {1: "big", 2: "first", 3: "first"}
