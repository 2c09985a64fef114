"""Named queries over the input tables, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

#: Modules of this folder that hold QUERIES and, where SQL can express them, ORACLE.
MODULES = ("snapshot_queries", "ledger_queries", "retrieval_queries", "document_queries", "claim_queries", "stream_queries", "report_queries", "listing_queries", "answer_queries")


def collected() -> tuple[dict, dict]:
    """All queries, and all SQL texts, by name."""
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        repeated = queries.keys() & module.QUERIES.keys()
        if repeated:
            raise ValueError(f"queries named twice: {sorted(repeated)}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
