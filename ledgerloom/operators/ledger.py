"""Facts of a ledger, their conflicts, and the value of each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.functions.periods import real_date, with_period_key
from ledgerloom.functions.text import alias_key, entity_fold
from ledgerloom.functions.unit_text import UNIT_WORDS

#: Amounts beyond this are not faithfully a double; they are skipped, not compared.
LARGEST = 9007199254740991.0


def measure_aliases(measures: DataFrame) -> DataFrame:
    """alias -> slug, by label, alias or slug; of several measures with one alias the first by slug."""
    names = measures.select("slug", F.explode(F.concat(F.array("slug", "label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    return names.where("a IS NOT NULL").groupBy(alias_key(F.col("a")).alias("alias")).agg(F.min("slug").alias("slug"))


def measure_units(measures: DataFrame) -> DataFrame:
    """slug, unit, factor, with the measure's tolerance."""
    return measures.select("slug", "tolerance_kind", "tolerance", F.explode("units").alias("u")).select("slug", "tolerance_kind", "tolerance", F.col("u.id").alias("unit"), F.col("u.to_canonical_factor").alias("factor"))


def written_unit(unit: Column) -> Column:
    """The unit id a field commonly written stands for; other texts stand for themselves, trimmed."""
    words = F.create_map(*[F.lit(x) for unit_id, forms in UNIT_WORDS.items() for form in forms for x in (form, unit_id)])
    bare = F.trim(unit)
    return F.coalesce(F.try_element_at(words, F.lower(bare)), bare)


def ledger_facts(facts: DataFrame, measures: DataFrame) -> DataFrame:
    """Facts with normalised keys: one row per fact_id, with entity_key, metric_slug, period_key, group_key, observed_on,
    and canonical (the amount in the measure's unit, null if it cannot be converted).

    A fact stored several times counts once (its latest ingestion).  A metric that is no label, alias or slug has no slug
    and no group.  Units are read as they are commonly written (UNIT_WORDS).  Null entities fall back to the quoted one.
    """
    require(facts, "fact_id", "entity", "entity_quote", "metric", "period_text", "amount", "unit", "ingested_at", "created_at", "observed_at_text")
    newest = Window.partitionBy("fact_id").orderBy(F.col("ingested_at").desc_nulls_last())
    once = facts.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    folded = once.withColumn("entity_key", entity_fold(F.coalesce("entity", "entity_quote"))).withColumn("_period_fold", entity_fold(F.col("period_text")))
    keyed = with_period_key(folded, "period_text", "_period_fold", "period_key").withColumn("_alias", alias_key(F.col("metric")))
    units = measure_units(measures).select(F.col("slug").alias("_slug"), F.col("unit").alias("_unit"), "factor")
    kinds = measures.select(F.col("slug").alias("metric_slug"), "tolerance_kind", "tolerance").dropDuplicates(["metric_slug"])
    named = keyed.join(measure_aliases(measures).select(F.col("alias").alias("_alias"), F.col("slug").alias("metric_slug")), "_alias", "left")
    measured = named.withColumn("unit", written_unit(F.col("unit"))).join(units, (F.col("metric_slug") == F.col("_slug")) & (F.col("unit") == F.col("_unit")), "left").join(kinds, "metric_slug", "left")
    canonical = F.col("amount") * F.col("factor")
    return measured.select(
        "fact_id", "tenant_id", "source_id", "document_id", "document_version_id", "source_class", "entity_key", "metric_slug", "period_key",
        F.concat_ws("::", "entity_key", "metric_slug", "period_key").alias("group_key"), "amount", "unit", "factor", "tolerance_kind", "tolerance",
        F.when(F.abs(canonical) <= LARGEST, canonical).alias("canonical"), "confidence", "extraction_method", "withdrawn", "superseded",
        real_date(F.trim("observed_at_text")).alias("observed_on"), "created_at", "ingested_at", "raw_text",
    )


def beyond_tolerance(low: Column, high: Column, kind: Column, tolerance: Column) -> Column:
    """Whether two values disagree: strictly more than the tolerance apart, absolutely or relative to the larger size."""
    diff, base = F.abs(high - low), F.greatest(F.abs(low), F.abs(high))
    return F.when(kind == "absolute", diff > tolerance).otherwise(F.when(base == 0, diff > 0).otherwise(diff / base > tolerance))


def within_tolerance(a: Column, b: Column, kind: Column, tolerance: Column) -> Column:
    """Whether a stated value is supported by another: at most the tolerance apart."""
    diff = F.abs(a - b)
    return F.when(kind == "absolute", diff <= tolerance).otherwise(diff <= tolerance * F.greatest(F.abs(a), F.abs(b)))


def detect_conflicts(facts: DataFrame) -> DataFrame:
    """Cells whose convertible facts disagree: group_key, entity_key, metric_slug, period_key, n_facts, n_skipped, magnitude,
    fact_ids (sorted).

    Facts without a known metric are in no group; those that cannot be converted are counted as skipped.  One aggregation,
    with partial results before the shuffle, finds the cells in conflict; only their facts are read again for the ids.  Give
    a frame that is cheap to read twice.
    """
    known = facts.where("metric_slug IS NOT NULL AND entity_key IS NOT NULL")
    cells = known.groupBy("tenant_id", "group_key").agg(
        F.first("entity_key").alias("entity_key"), F.first("metric_slug").alias("metric_slug"), F.first("period_key").alias("period_key"),
        F.first("tolerance_kind").alias("tolerance_kind"), F.first("tolerance").alias("tolerance"),
        F.count("canonical").alias("n_facts"), F.count_if(F.col("canonical").isNull()).alias("n_skipped"),
        F.min("canonical").alias("low"), F.max("canonical").alias("high"),
    )
    keys = ["tenant_id", "group_key"]
    apart = cells.where((F.col("n_facts") >= 2) & beyond_tolerance(F.col("low"), F.col("high"), F.col("tolerance_kind"), F.col("tolerance")))
    members = known.where("canonical IS NOT NULL").select(*keys, "fact_id").join(apart.select(*keys), keys, "left_semi")
    ids = members.groupBy(*keys).agg(F.array_sort(F.collect_list("fact_id")).alias("fact_ids"))
    return apart.join(ids, keys).select(
        "tenant_id", "group_key", "entity_key", "metric_slug", "period_key", "n_facts", "n_skipped", (F.col("high") - F.col("low")).alias("magnitude"), "fact_ids",
    )


def stored_conflicts(conflicts: DataFrame) -> DataFrame:
    """Conflicts once each, with the resolution's parts as columns and the member set in one order."""
    require(conflicts, "conflict_id", "group_key", "fact_ids", "status", "resolution", "created_at")
    return conflicts.dropDuplicates(["conflict_id"]).select(
        "conflict_id", "tenant_id", "group_key", F.array_sort(F.array_distinct("fact_ids")).alias("fact_ids"), "magnitude", "status",
        F.col("resolution.outcome").alias("outcome"), F.col("resolution.winning_fact_id").alias("winning_fact_id"), F.col("resolution.resolved_at").alias("resolved_at"), "created_at",
    )


def reconcile_conflicts(candidates: DataFrame, stored: DataFrame, skipped_groups: DataFrame) -> DataFrame:
    """What a scan does to the stored conflicts of each cell: tenant_id, group_key, action (insert, grow, retract, keep).

    An open conflict with the same members is kept, with others it grows; a candidate whose members equal a closed conflict
    is kept; other candidates are inserted; an open conflict without candidate is retracted, unless a fact of its cell was
    skipped (then nothing can be told, and it is kept).  Cells that are only closed and no candidates are absent.
    """
    keys = ["tenant_id", "group_key"]
    open_ = stored.where("status = 'open'").groupBy(*keys).agg(F.max_by("fact_ids", "created_at").alias("open_ids"))
    closed = stored.where("status <> 'open'").groupBy(*keys).agg(F.collect_set("fact_ids").alias("closed_ids"))
    new = candidates.select(*keys, F.array_sort(F.array_distinct("fact_ids")).alias("new_ids"))
    skipped = skipped_groups.select(*keys).distinct().withColumn("_skipped", F.lit(True))
    merged = new.join(open_, keys, "full_outer").join(closed, keys, "left").join(skipped, keys, "left")
    same_closed = F.coalesce(F.array_contains("closed_ids", F.col("new_ids")), F.lit(False))
    action = (
        F.when(F.col("new_ids").isNotNull() & F.col("open_ids").isNotNull(), F.when(F.col("new_ids") == F.col("open_ids"), "keep").otherwise("grow"))
        .when(F.col("new_ids").isNotNull(), F.when(same_closed, "keep").otherwise("insert"))
        .otherwise(F.when(F.col("_skipped"), "keep").otherwise("retract"))
    )
    return merged.select(*keys, action.alias("action"))


def propose_survivor(facts: DataFrame, measures: DataFrame) -> DataFrame:
    """A proposed winner for each cell with facts: group_key, basis (authority, recency, none), reason, fact_id.

    The first rule that applies decides: fewer than two facts; no authority order; an order that repeats a class; an
    unclassified fact; a class that is not in the order (all: none).  Then one fact of the lowest rank wins by authority.
    Among several of the lowest rank: one without observation time, or no staleness window, or a gap between the two
    freshest of at most the window: none; else the freshest wins by recency.
    """
    order = measures.select(F.col("slug").alias("metric_slug"), "authority_order", "staleness_window_ms").dropDuplicates(["metric_slug"])
    ranked = facts.where("metric_slug IS NOT NULL").join(order, "metric_slug").withColumn("rank", F.array_position("authority_order", F.col("source_class")))
    cell = Window.partitionBy("tenant_id", "group_key")
    best = F.min(F.when(F.col("rank") > 0, F.col("rank"))).over(cell)
    freshest = cell.orderBy(F.col("_top").desc(), F.col("observed_on").desc_nulls_last(), F.col("created_at").desc(), "fact_id")
    scored = (
        ranked.withColumn("_top", F.coalesce((F.col("rank") == best).cast("int"), F.lit(0)))
        .withColumn("_n", F.row_number().over(freshest)).withColumn("_next", F.lead("observed_on").over(freshest))
    )
    cells = scored.groupBy("tenant_id", "group_key").agg(
        F.count("*").alias("n"), F.first("authority_order").alias("authority_order"), F.first("staleness_window_ms").alias("window"),
        F.bool_or(F.coalesce(F.col("source_class"), F.lit("unclassified")) == "unclassified").alias("unclassified"), F.bool_or(F.coalesce(F.col("rank"), F.lit(0)) == 0).alias("outside"),
        F.sum("_top").alias("n_top"), F.bool_or((F.col("_top") == 1) & F.col("observed_on").isNull()).alias("unobserved"),
        F.max(F.when(F.col("_n") == 1, F.col("fact_id"))).alias("first_id"), F.max(F.when(F.col("_n") == 1, F.datediff("observed_on", "_next"))).alias("gap_days"),
    )
    repeats = F.size("authority_order") != F.size(F.array_distinct("authority_order"))
    stale = F.col("gap_days").cast("double") * 86_400_000 > F.col("window")
    reason = (
        F.when(F.col("n") < 2, "too-few-facts").when(F.col("authority_order").isNull() | (F.size("authority_order") == 0), "no-authority-order").when(repeats, "authority-order-repeats")
        .when(F.col("unclassified"), "fact-unclassified").when(F.col("outside"), "class-outside-order").when(F.col("n_top") == 1, "highest-authority")
        .when(F.col("unobserved"), "tie-unobserved").when(F.col("window").isNull(), "no-staleness-window").when(stale, "freshest-of-tie").otherwise("gap-within-window")
    )
    basis = F.when(F.col("reason") == "highest-authority", "authority").when(F.col("reason") == "freshest-of-tie", "recency").otherwise("none")
    return cells.withColumn("reason", reason).select("tenant_id", "group_key", basis.alias("basis"), "reason", F.when(basis != "none", F.col("first_id")).alias("fact_id"))


def resolve_cells(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """The state of every cell: tenant_id, group_key, state, canonical, conflict_id, winner_withdrawn, n_ids.

    In order: an open conflict -> conflicted; else the latest resolved conflict whose winner is a fact of the cell ->
    adjudicated, with the winner's value, also if it is withdrawn since; else no active fact (withdrawn and superseded ones
    are not) -> unknown; else active values beyond the tolerance -> conflicted; else single, with the value observed last
    (one observed beats one not; then the one created last, then the smaller id).
    """
    keys = ["tenant_id", "group_key"]
    known = facts.where("metric_slug IS NOT NULL AND entity_key IS NOT NULL")
    active = ~F.coalesce(F.col("withdrawn"), F.lit(False)) & ~F.coalesce(F.col("superseded"), F.lit(False))
    # Latest first, as numbers, so that one aggregation with partial results finds the value observed last.
    order = F.struct(F.coalesce(-F.unix_date("observed_on"), F.lit(2**31 - 1)), F.coalesce(-F.unix_micros("created_at"), F.lit(2**63 - 1)), F.col("fact_id"))
    value = F.when(active, F.col("canonical"))
    cells = known.groupBy(*keys).agg(
        F.count_if(active).alias("n_active"), F.count(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.first("tolerance_kind").alias("tolerance_kind"), F.first("tolerance").alias("tolerance"), F.min_by(F.struct("canonical"), F.when(active, order)).alias("single"),
    )
    open_ = stored.where("status = 'open'").groupBy(*keys).agg(F.min_by(F.struct("conflict_id", F.size("fact_ids").alias("n")), F.struct("created_at", "conflict_id")).alias("open"))
    winners = known.select(*keys, F.col("fact_id").alias("winning_fact_id"), F.col("canonical").alias("won"), F.coalesce("withdrawn", F.lit(False)).alias("won_withdrawn"))
    ruled = (
        stored.where("status = 'resolved' AND outcome = 'resolved'").join(winners, [*keys, "winning_fact_id"])
        .groupBy(*keys).agg(F.max_by(F.struct("conflict_id", "won", "won_withdrawn", F.size("fact_ids").alias("n")), F.struct("resolved_at", F.col("conflict_id"))).alias("ruled"))
    )
    joined = cells.join(open_, keys, "left").join(ruled, keys, "left")
    apart = (F.col("n_values") >= 2) & beyond_tolerance(F.col("low"), F.col("high"), F.col("tolerance_kind"), F.col("tolerance"))
    state = F.when(F.col("open").isNotNull(), "conflicted").when(F.col("ruled").isNotNull(), "adjudicated").when(F.col("n_active") == 0, "unknown").when(apart, "conflicted").otherwise("single")
    s = joined.withColumn("state", state)
    return s.select(
        *keys, "state",
        F.when(F.col("state") == "adjudicated", F.col("ruled.won")).when(F.col("state") == "single", F.col("single.canonical")).alias("canonical"),
        F.when(F.col("open").isNotNull(), F.col("open.conflict_id")).when(F.col("state") == "adjudicated", F.col("ruled.conflict_id")).alias("conflict_id"),
        F.when(F.col("state") == "adjudicated", F.col("ruled.won_withdrawn")).alias("winner_withdrawn"),
        F.when(F.col("open").isNotNull(), F.col("open.n")).when(F.col("state") == "adjudicated", F.col("ruled.n")).when(F.col("state") == "unknown", 0).otherwise(F.col("n_active")).cast("bigint").alias("n_ids"),
    )


def agree_facts(votes: DataFrame, least: int = 2) -> DataFrame:
    """Facts that several passes agree on: tenant_id, group_key, fact_id (of the earliest pass), n_passes, confidence (mean).

    ``votes``: tenant_id, group_key, pass (int), fact_id, canonical, confidence, tolerance_kind, tolerance.  Around each
    vote as pivot stands the first vote of every pass within its tolerance; the largest such set wins (ties: the earlier
    pivot).  Votes without a value do not count; of equal values of a pass the first stands for all.  Order within a cell is (pass, fact_id).
    """
    keys = ["tenant_id", "group_key"]
    c, tol = F.col("canonical"), F.col("tolerance")
    # Buckets as wide as the tolerance (of logarithms, if it is relative): values that agree lie in one or in neighbours, so
    # a cell of any size is never compared with all of itself.
    size = F.when(tol <= 0, F.xxhash64("canonical")).when(F.col("tolerance_kind") == "absolute", F.floor(c / tol)).when(c == 0, 0).otherwise(F.floor(F.ln(F.abs(c)) / -F.ln(1 - tol)) * 2 + (c > 0).cast("int"))
    step = F.when(tol <= 0, 0).when(F.col("tolerance_kind") == "absolute", 1).otherwise(2)
    same = votes.where("canonical IS NOT NULL AND group_key IS NOT NULL").groupBy(*keys, "pass", "canonical", "tolerance_kind", "tolerance").agg(F.min(F.struct("fact_id", "confidence")).alias("_v"))
    v = same.select(*keys, "pass", "canonical", "tolerance_kind", "tolerance", "_v.*", size.cast("bigint").alias("_bucket"), step.alias("_step"))
    p = v.select(*keys, F.struct("pass", "fact_id").alias("pivot"), F.col("canonical").alias("_center"), F.explode(F.array_distinct(F.array(F.col("_bucket") - F.col("_step"), F.col("_bucket"), F.col("_bucket") + F.col("_step")))).alias("_bucket"))
    near = p.join(v, [*keys, "_bucket"]).where(~beyond_tolerance(F.col("_center"), F.col("canonical"), F.col("tolerance_kind"), F.col("tolerance")))
    first = near.groupBy(*keys, "pivot", "pass").agg(F.min(F.struct("fact_id", "confidence")).alias("vote"))
    sets = first.groupBy(*keys, "pivot").agg(F.count("*").alias("n_passes"), F.avg("vote.confidence").alias("confidence"), F.min(F.struct("pass", F.col("vote.fact_id").alias("fact_id"))).alias("earliest"))
    best = sets.groupBy(*keys).agg(F.min(F.struct((-F.col("n_passes")).alias("n"), "pivot", "earliest", "confidence")).alias("b"))
    return best.where(F.col("b.n") <= -least).select(*keys, F.col("b.earliest.fact_id").alias("fact_id"), (-F.col("b.n")).alias("n_passes"), F.col("b.confidence").alias("confidence"))
