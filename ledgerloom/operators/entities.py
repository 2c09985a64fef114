"""Resolving typed entity names against a registry of canonical names and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.text import entity_fold, near_match_fold


def resolve_entities(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``canonical_name`` to rows with ``name``: the entity whose folded name or alias equals it.

    ``registry``: canonical_name, alias (both folded).  An alias of several entities matches none; so does a null name.
    """
    require(names, "name")
    require(registry, "canonical_name", "alias")
    clear = registry.groupBy("alias").agg(F.countDistinct("canonical_name").alias("_n"), F.min("canonical_name").alias("canonical_name")).where("_n = 1").drop("_n")
    return names.withColumn("_fold", entity_fold(F.col("name"))).join(clear, F.col("_fold") == F.col("alias"), "left").drop("_fold", "alias")


def near_matches(names: DataFrame, registry: DataFrame) -> DataFrame:
    """Unregistered names that a registered one equals under the near-match form: name, fact_id (the newest), canonical_name.

    ``names``: name, fact_id, created_at.  Forms that several entities share match none.
    """
    require(names, "name", "fact_id", "created_at")
    folded = names.select(entity_fold(F.col("name")).alias("name"), "fact_id", "created_at").where("name IS NOT NULL")
    open_ = folded.groupBy("name").agg(F.max(F.struct("created_at", "fact_id")).alias("_newest")).join(registry.select(F.col("alias").alias("name")).distinct(), "name", "left_anti")
    keys = registry.groupBy(near_match_fold(F.col("alias")).alias("_key")).agg(F.countDistinct("canonical_name").alias("_n"), F.min("canonical_name").alias("canonical_name")).where("_n = 1 AND _key <> ''")
    return open_.withColumn("_key", near_match_fold(F.col("name"))).join(keys, "_key").select("name", F.col("_newest.fact_id").alias("fact_id"), "canonical_name")
