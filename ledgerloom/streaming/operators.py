"""Streaming operators: daily sums, first sightings, and the state of files over sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_sums(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sum and number of events per type and UTC day; rows later than ``late`` behind the newest are dropped by the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "total", "n")


def first_sightings(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, without watermark: the keys are remembered for good."""
    return events.dropDuplicates(keys)


def quarter_hour_counts(events: DataFrame) -> DataFrame:
    """Events per type in two-hour windows that slide by a quarter of an hour."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "2 hours", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


CHANGE = "source_id bigint, path string, sweep_no int, change_kind string"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, live, digest = state.get if state.exists else (-1, False, "")
    rows = pd.concat(list(batches)).sort_values(["sweep_no", "hash"])
    out = []
    for r in rows.itertuples(index=False):
        if r.sweep_no <= seen:
            continue
        seen = int(r.sweep_no)
        now = not r.withdrawn
        if now and not live:
            out.append((seen, "added"))
        elif live and not now:
            out.append((seen, "removed"))
        elif now and r.hash != digest:
            out.append((seen, "changed"))
        live, digest = now, r.hash if now else digest
    state.update((seen, live, digest))
    yield pd.DataFrame([(key[0], key[1], n, k) for n, k in out], columns=["source_id", "path", "sweep_no", "change_kind"])


def follow_files(entries: DataFrame) -> DataFrame:
    """Changes of each file over its entries: added, changed, removed (withdrawn), by state per file.

    ``entries``: source_id, path, sweep_no, hash, withdrawn.  Entries of a sweep not after the last one seen are ignored, so
    that a delivery repeated does nothing.  A null hash is a value of its own.
    """
    ready = entries.select("source_id", "path", F.col("sweep_no").cast("int"), F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"))
    return ready.groupBy("source_id", "path").applyInPandasWithState(_follow, CHANGE, "seen int, live boolean, digest string", "append", GroupStateTimeout.NoTimeout)
