"""Listings, lives of documents and measures, figures and locators on small frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import figures, lifecycle, listing, locators


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_projections_and_sorting(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", 1.0), (3, "a", 2.0)], "id int, name string, v double")
    assert listing.pick_fields(df, " name ,id,nope,name", "id").columns == ["id", "name"] and listing.pick_fields(df, " ", "id").columns == df.columns
    assert listing.whitelisted(df, ("v", "w")).columns == ["v", "w"] and listing.without(df, "v", "zz").columns == ["id", "name"]
    assert [r.id for r in listing.sorted_by(df, "name", "desc", ("name",), "id", "id").collect()] == [1, 2, 3] and [r.id for r in listing.sorted_by(df, "v", None, ("name",), "id", "id").collect()] == [1, 2, 3]
    assert listing.with_ids(df, "id", [1, 3]).count() == 2 and listing.with_ids(df, "id", df.where("id > 1").select("id")).count() == 2
    with pytest.raises(ValueError, match="as a frame"):
        listing.with_ids(df, "id", list(range(2000)))
    with pytest.raises(ValueError, match="2, 3"):
        listing.refuse_missing(df, df.where("id = 1"), "id")


def test_expressions(spark):
    at = F.array(F.struct(F.lit("p").alias("path"), F.lit(None).cast("int").alias("source_id")))
    assert one(spark, listing.has_location(at, F.lit("p"), F.lit(None).cast("int"))) and not one(spark, listing.has_location(at, F.lit("p"), F.lit(1)))
    assert one(spark, listing.within_ceiling(F.lit(None), F.lit(3), F.lit(2), F.lit(5))) and not one(spark, listing.within_ceiling(F.lit(1), F.lit(3), F.lit(2), F.lit(5)))
    assert one(spark, listing.locator_order(F.lit("xlsx-cell"), F.lit(1), F.lit("A10"))) < one(spark, listing.locator_order(F.lit("xlsx-cell"), F.lit(1), F.lit("A2")))
    assert one(spark, listing.appended(F.lit(None).cast("array<string>"), F.lit("a"))) == ["a"]
    nested = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.struct(F.lit(2.5).alias("b"), F.lit(float("inf")).alias("c"), F.lit("x").alias("d")).alias("e")).alias("m"), F.lit(3).alias("z"))
    assert {r.metric: r.value for r in listing.flat_metrics(nested, ("z",)).collect()} == {"m.a": 1.0, "m.e.b": 2.5}


@pytest.mark.parametrize(("value", "unit", "forms"), [(1234.5, "usd", ["1234.5", "1,234.5", "1234.50"]), (5.0, "percent", ["5", "5.00", "5%", "5.00%"]), (-1000.0, None, ["-1000", "-1,000", "-1000.00"]), (None, "usd", None)])
def test_value_variants(spark, value, unit, forms):
    assert one(spark, figures.value_variants(F.lit(value).cast("double"), F.lit(unit))) == forms


@pytest.mark.parametrize(("value", "kind", "forms"), [(1234567.0, "currency", ["1,234,567", "1,235", "1"]), (-1234567.4, "currency", ["(1,234,567)", "(1,235)", "(1)"]), (0.4, "currency", ["0"]), (1.005, "per-share", ["1.00"]), (-2.5, "per-share", ["(2.50)"]), (41.5, "count", ["42"]), (None, "count", None)])
def test_rendered_forms(spark, value, kind, forms):
    got = one(spark, figures.rendered_forms(F.lit(value).cast("double"), F.lit(kind)))
    assert (got and [f.text for f in got]) == forms


def test_samples_follow_the_seed(spark):
    assert next(figures.seeded(1)) == pytest.approx(0.6270739405881613, abs=1e-15)
    assert figures.drawn(5, 3) == [0, 1, 2, 3, 4] and figures.drawn(100, 3) == figures.drawn(100, 3) != figures.drawn(100, 4) and len(set(figures.drawn(100, 3))) == 20
    df = spark.range(50).select(F.col("id").alias("case_id"))
    assert sorted(r.case_id for r in figures.adjudication_sample(df, "case_id", 3).collect()) == figures.drawn(50, 3)
    with pytest.raises(ValueError, match="population"):
        figures.drawn(2_000_000, 1)


def test_located_values(spark):
    v = spark.createDataFrame([(1, "f", [("5,000", 1), ("5", 1000)], ["Rent"]), (2, "f", [("7", 1)], ["rent"]), (3, "f", [("50", 1)], ["rent"]), (4, "g", [("5", 1)], ["rent"]), (5, "f", [], ["rent"])], "value_id int, file string, forms array<struct<text string, scale int>>, labels array<string>")
    e = spark.createDataFrame([("f", 10, "the rent is 5,000", "the rent is"), ("f", 11, "15,000 and 5", "area"), ("f", 12, "7 or 7", "RENT"), ("f", 13, "7", "rent"), ("f", 14, None, None)], "file string, element_id int, text string, label string")
    assert {r.value_id: (r.element_id, r.text, r.scale, r.reason) for r in figures.locate_values(v, e).collect()} == {1: (10, "5,000", 1, None), 2: (None, None, None, "ambiguous"), 3: (None, None, None, "not-found"), 4: (None, None, None, "not-found"), 5: (None, None, None, "not-found")}


def test_locators(spark):
    el = [(1, "rent  is due"), (2, "area")]
    c = spark.createDataFrame([("a", "f", "xlsx-region", "S", "A1:C4", None, "x"), ("b", "f", "docx-paragraph", None, None, el, "rent is due area"), ("c", "f", "docx-paragraph", None, None, [], "the “rent” is due"), ("d", "g", "text-block", None, None, None, "")], "chunk_id string, file string, kind string, sheet string, address string, elements array<struct<index int, text string>>, text string")
    e = spark.createDataFrame([("1", "f", "xlsx-cell", "S", "C4", None, None), ("2", "f", "xlsx-cell", "S", "D4", None, None), ("3", "f", "docx-paragraph", None, None, 2, '"rent" is'), ("4", "f", "docx-paragraph", None, None, 9, " "), ("5", "g", "text-block", None, None, 0, "")], "case_id string, file string, kind string, sheet string, address string, index int, text string")
    assert sorted(map(tuple, locators.expected_overlaps(c, e).collect())) == [("1", "a"), ("3", "b"), ("3", "c")]
    pieces = c.select("chunk_id", locators.citation_index(F.col("elements"), F.lit("rent is")).alias("i"))
    assert {r.chunk_id: r.i for r in pieces.collect()} == {"a": None, "b": 1, "c": None, "d": None}


def test_versions_and_attempts(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    a = spark.createDataFrame([("j", 1, at(0), at(5)), ("j", 2, at(3), at(4)), ("j", 3, at(9), at(10)), ("k", 1, at(0), None)], "job string, token int, started_at timestamp, finished_at timestamp")
    assert {(r.job, r.token): r.accepted for r in lifecycle.fenced_attempts(a).collect()} == {("j", 1): False, ("j", 2): True, ("j", 3): True, ("k", 1): True}
    r = spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(0))], "request_id int, opened_at timestamp")
    got = spark.createDataFrame([(1, at(24), "yes"), (1, at(2), "no"), (2, at(25), "yes")], "request_id int, answered_at timestamp, outcome string")
    assert {x.request_id: x.outcome for x in lifecycle.gate_outcomes(r, got).collect()} == {1: "no", 2: "timed_out", 3: "timed_out"}
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "fact_id string, document_version_id int")
    v = spark.createDataFrame([(1, "d", None), (2, "d", at(1))], "document_version_id int, document_id string, withdrawn_at timestamp")
    d = spark.createDataFrame([("d", 2)], "document_id string, current_version_id int")
    assert {x.fact_id: (x.withdrawn, x.superseded) for x in lifecycle.fact_lifecycle(f, v, d).collect()} == {"a": (False, True), "b": (True, False)}


def test_views_against_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randint(0, 3)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 5000)), i) for i in range(400)]
    got = sorted(r.view_id for r in lifecycle.recorded_views(spark.createDataFrame(rows, "key string, ts timestamp, view_id int"), 300).collect())
    last, want = {}, []
    for key, ts, i in sorted(rows):
        if key not in last or (ts - last[key]).total_seconds() >= 300:
            last[key] = ts
            want.append(i)
    assert got == sorted(want)


@pytest.mark.parametrize(("content", "fault"), [("YQ==", None), ("YQ=", "not-base64"), ("Y*==", "not-base64"), ("", "empty"), (None, "empty"), ("=YQ=", "not-base64")])
def test_submissions(spark, content, fault):
    assert lifecycle.submitted(spark.createDataFrame([(1, content)], "submission_id int, content_base64 string")).first().fault == fault


def test_measures_proposed_and_decided(spark):
    at = dt.datetime(2024, 1, 1)
    u = spark.createDataFrame([(f"f{i:03d}", "Net Income" if i % 3 else "net income ", at) for i in range(120)] + [("x", "2024", at), ("y", None, at)], "fact_id string, metric string, created_at timestamp")
    (p,) = lifecycle.propose_measures(u).collect()
    assert (p.slug, p.label, p.n_facts, len(p.evidence)) == ("net_income", "Net Income", 120, 50)
    m = spark.createDataFrame([("a", "proposed", 1), ("b", "proposed", 2), ("c", "confirmed", 3)], "slug string, status string, measure_version int")
    d = spark.createDataFrame([("a", "confirm"), ("b", "reject")], "slug string, decision string")
    assert {r.slug: tuple(r)[1:] for r in lifecycle.decide_measures(m, d).collect()} == {"a": ("confirmed", 2, True), "b": ("rejected", 2, False), "c": ("confirmed", 3, False)}
