"""A few queries against their SQL, and the contract of the entry module."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
CHECKED = (
    "p1_found", "conflict_scan", "ledger_cells", "vector_hits", "withdrawn_files", "spend_stream", "survivorship_proposals", "agreed_facts", "eval_retrieval", "eval_metrics", "eval_variance", "quotes_in_documents", "conflict_list", "located_values", "locator_overlaps",
    "fenced_deliveries", "recorded_views", "inline_submissions", "question_conflicts", "answer_outcomes", "ledger_values", "attestation_bundles", "measure_proposals", "conflict_reconcile",
)


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_rows_equal_those_of_the_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)


def test_every_sql_has_its_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_nothing_outside_imports_the_optional_part():
    root = Path(entry.__file__).parent / "ledgerloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "ledgerloom.llm" not in p.read_text(), p
    assert os.path.exists(root)
