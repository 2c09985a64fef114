"""What changed between consecutive full snapshots.

``EXCEPT ALL`` in both directions removes what two snapshots share; a full join of what is left, by key, tells additions,
removals and changes apart (each side has a key and rank once, so the join is an aggregation over co-located sides).
Catalyst rewrites each ``EXCEPT ALL`` into a union of both sides with signs and a sum of the
signs per distinct row.  Both directions are the two signs of that one sum, so they are computed together here: every
snapshot is read once and shuffled once for both of its roles (later than one neighbour, earlier than the other).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.unicode import nfc


def with_neighbours(versions: DataFrame, series: Sequence[str], version: str, pick: Sequence[str] = ()) -> DataFrame:
    """Each version of a series once, with the version before (``_previous``) and after (``_next``), null at the ends."""
    w = Window.partitionBy(*series).orderBy(version)
    return (
        versions.select(*series, version, *pick).dropDuplicates([*series, version])
        .withColumn("_previous", F.lag(version).over(w))
        .withColumn("_next", F.lead(version).over(w))
    )


def snapshot_changes(records: DataFrame, versions: DataFrame, series: Sequence[str], version: str, key: Sequence[str], compare: Sequence[str], pick: Sequence[str] = ()) -> DataFrame:
    """Changes from each snapshot of a series to the next.

    ``records`` holds the rows of all snapshots, ``versions`` says which (series, version) were delivered (a snapshot
    without rows is one too; rows of other versions are ignored).  ``pick`` names columns of both that must agree as well:
    of a version delivered several times, the delivery that stands for it.  The result has ``series``, ``version`` (the later
    one), ``key``, ``change_kind`` (added, removed, changed) and structs ``before`` and ``after`` of ``compare``.

    * The first snapshot of a series has no changes.  Empty inputs give an empty result.
    * Nulls compare equal to nulls, in keys and in compared columns.  Columns not named are ignored.
    * Rows count as often as they occur.  If several rows of one key are left on a side, they are paired in the order of
      their compared values, and what has no partner was added or removed.
    """
    require(records, *series, version, *key, *compare, *pick)
    order = with_neighbours(versions, series, version, pick)
    values = F.struct(*[F.col(f"`{c}`") for c in compare])
    rows = records.select(*series, version, *pick, *key, values.alias("_value"))
    both = rows.join(order, [*series, version, *pick]).select(
        *series, *key, "_value",
        F.explode(F.array(
            F.struct(F.when(F.col("_previous").isNotNull(), F.col(version)).alias("at"), F.lit(1).alias("sign")),
            F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign")),
        )).alias("_role"),
    ).where("_role.at IS NOT NULL")
    surplus = (
        both.groupBy(*series, F.col("_role.at").alias(version), *key, "_value")
        .agg(F.sum("_role.sign").alias("_n"))
        .where("_n <> 0")
    )
    # One shuffle of the residues by key serves the ranks and the full join: both sides meet in the same partition.
    ids = [*series, version, *key]
    left = surplus.select(*ids, "_value", (F.col("_n") > 0).alias("_later"), F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_copy")).repartition(*ids)
    ranked = left.withColumn("_rank", F.row_number().over(Window.partitionBy(*ids, "_later").orderBy("_value", "_copy")))
    sides = ranked.groupBy(*ids, "_rank").agg(
        F.bool_or(F.col("_later")).alias("_new"), F.bool_or(~F.col("_later")).alias("_old"),
        F.max(F.when(~F.col("_later"), F.col("_value"))).alias("before"), F.max(F.when(F.col("_later"), F.col("_value"))).alias("after"),
    )
    kind = F.when(F.col("_new") & F.col("_old"), "changed").when(F.col("_new"), "added").otherwise("removed")
    return sides.select(*ids, kind.alias("change_kind"), "before", "after")


def canonical_path(path: Column) -> Column:
    """One notation of a relative path: forward slashes, no doubled ones, no leading ``./`` or ``/``, Unicode NFC."""
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/")
    return nfc(F.regexp_replace(slashes, r"^(?:\./)*/?(?:\./)*", ""))


def canonical_hash(digest: Column) -> Column:
    """The hexadecimal value in lower case without a prefix; empty where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(digest)), r"^(?:sha-?256:|0x)", ""), F.lit(""))


def delivered_listing(file_states: DataFrame) -> DataFrame:
    """One row per (source_id, sweep_no, delivery_no, path) with the highest hash of its live entries, null if none is live.

    Entries without a path are no files.
    """
    live = F.col("withdrawn_at").isNull()
    return (
        file_states.where("path IS NOT NULL AND trim(path) <> ''")
        .select("source_id", "sweep_no", "delivery_no", canonical_path(F.col("path")).alias("path"), F.when(live, canonical_hash(F.col("sha256"))).alias("_hash"))
        .groupBy("source_id", "sweep_no", "delivery_no", "path").agg(F.max("_hash").alias("hash"))
    )


def usable_sweeps(listing: DataFrame, source_sweeps: DataFrame) -> DataFrame:
    """Of each sweep the highest complete delivery: it lists as many distinct paths as its ``file_count`` says.

    ``listing`` has one row per (source_id, sweep_no, delivery_no, path).  A null count is never complete; a count of 0
    is complete if nothing is listed.
    """
    # _live is there so that this use of the listing needs the same columns as the other: one exchange then serves both.
    listed = listing.groupBy("source_id", "sweep_no", "delivery_no").agg(F.count("*").alias("_listed"), F.count("hash").alias("_live"))
    delivered = source_sweeps.select("source_id", "sweep_no", "delivery_no", "file_count").where("file_count IS NOT NULL").distinct()
    return (
        delivered.join(listed, ["source_id", "sweep_no", "delivery_no"], "left")
        .where((F.coalesce("_listed", F.lit(0)) == F.col("file_count")) & (F.coalesce("_live", F.lit(0)) <= F.col("file_count")))
        .groupBy("source_id", "sweep_no").agg(F.max("delivery_no").alias("delivery_no"))
    )


def file_changes(file_states: DataFrame, source_sweeps: DataFrame) -> DataFrame:
    """Files added, removed or changed from one usable sweep of a source to the next.

    Result: source_id, sweep_no (the later sweep), path, change_kind.  Entries without a path are no files.  If one
    delivery lists a path several times, it is live if one entry is, and has the highest hash of the live entries.
    """
    require(file_states, "source_id", "sweep_no", "delivery_no", "path", "sha256", "withdrawn_at")
    require(source_sweeps, "source_id", "sweep_no", "delivery_no", "file_count")
    listing = delivered_listing(file_states)
    usable = usable_sweeps(listing, source_sweeps)
    changes = snapshot_changes(listing.where("hash IS NOT NULL"), usable, ["source_id"], "sweep_no", ["path"], ["hash"], pick=["delivery_no"])
    return changes.select("source_id", "sweep_no", "path", "change_kind")
