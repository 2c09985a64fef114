import random
from collections import Counter

from ledgerloom.operators.snapshots import file_changes, snapshot_changes

ROWS = "s bigint, v int, k string, x string, extra int"


def brute(rows, versions):
    out = Counter()
    for s in {a for a, _ in versions}:
        vs = sorted(v for a, v in versions if a == s)
        for before, after in zip(vs, vs[1:]):
            old = Counter((k, x) for a, v, k, x, _ in rows if (a, v) == (s, before))
            new = Counter((k, x) for a, v, k, x, _ in rows if (a, v) == (s, after))
            plus, minus = new - old, old - new
            for k in {k for k, _ in plus} | {k for k, _ in minus}:
                p, m = sum(n for (q, _), n in plus.items() if q == k), sum(n for (q, _), n in minus.items() if q == k)
                for kind, n in (("changed", min(p, m)), ("added", p - min(p, m)), ("removed", m - min(p, m))):
                    if n:
                        out[(s, after, k, kind)] += n
    return out


def test_equals_except_all_both_ways_and_a_full_join(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), rng.randint(1, 4), rng.choice(["a", "b", None, ""]), rng.choice(["x", "y", None]), 1) for _ in range(300)]
    versions = [(s, v) for s in (1, 2, 3) for v in (1, 2, 3, 4) if (s, v) != (2, 3)]
    got = snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(versions, "s bigint, v int"), ["s"], "v", ["k"], ["x"]).collect()
    assert Counter((r.s, r.v, r.k, r.change_kind) for r in got) == brute(rows, versions)


def test_a_snapshot_without_rows_removes_everything(spark):
    got = snapshot_changes(spark.createDataFrame([(1, 1, "a", "x", 0)], ROWS), spark.createDataFrame([(1, 1), (1, 2)], "s bigint, v int"), ["s"], "v", ["k"], ["x"]).collect()
    assert [(r.v, r.change_kind, r.before.x, r.after) for r in got] == [(2, "removed", "x", None)]


FILES = "source_id bigint, sweep_no int, delivery_no int, path string, sha256 string, withdrawn_at timestamp, hash string"
SWEEPS = "source_id bigint, sweep_no int, delivery_no int, file_count bigint"


def test_file_changes(spark):
    f = [(1, 1, 1, "a/b.txt", "AB", None, "clash"), (1, 1, 1, ".\\a\\b.txt", "ab", None, None), (1, 1, 1, "c", None, None, None), (1, 2, 1, "only part", "1", None, None),
         (1, 3, 2, "a/b.txt", "aB", None, None), (1, 3, 2, "c", "00", None, None), (1, 3, 2, "données", None, None, None), (1, 3, 2, None, "1", None, None), (1, 3, 2, " ", "1", None, None)]
    s = [(1, 1, 1, 2), (1, 2, 1, 9), (1, 3, 1, None), (1, 3, 2, 3), (1, 4, 1, 0), (1, 4, 1, 0)]
    got = sorted((r.sweep_no, r.path, r.change_kind) for r in file_changes(spark.createDataFrame(f, FILES), spark.createDataFrame(s, SWEEPS)).collect())
    assert got == sorted([(3, "c", "changed"), (3, "données", "added"), (4, "a/b.txt", "removed"), (4, "c", "removed"), (4, "données", "removed")])


def test_empty_tables(spark):
    assert file_changes(spark.createDataFrame([], FILES), spark.createDataFrame([], SWEEPS)).count() == 0
