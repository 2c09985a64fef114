"""Support of claims against a plain version, aliases, claims of the ledger, outcomes."""

import random

import pytest

from ledgerloom.functions.claims import assertions_in
from ledgerloom.operators import aliases, answers, support


@pytest.mark.parametrize(("text", "wanted"), [
    ("a yield of 5.25%", [(5.25, "percentage", 0.0525)]), ("5 percent and 25 bps", [(5.0, "percentage", 0.05), (25.0, "percentage", 0.0025)]), ("25 basis points", [(25.0, "percentage", 0.0025)]), ("$1.5 million of USD 3", [(1.5, "currency", 1.5e6), (3.0, "currency", 3.0)]),
    ("12,000 sf and 40 square feet", [(12000.0, "area", 12000.0), (40.0, "area", 40.0)]), ("18 months of rent, 2 years", [(18.0, "duration", 1.5), (2.0, "duration", 2.0)]), ("about 7 k", [(7.0, "unknown", 7000.0)]), ("", []), ("none", []),
])
def test_kinds_of_numbers(text, wanted):
    assert [(v, k, pytest.approx(p)) for v, k, p in wanted] == assertions_in(text)


MEASURES = [("cap", "cap rate", None, "percentage", "absolute", 0.0025), ("noi", "net income", ["income"], "currency", "relative", 0.01), ("area", "floor area", None, "area", "relative", 0.01)]
MEASURE = "slug string, label string, aliases array<string>, value_type string, tolerance_kind string, tolerance double"


def supported(spark, claims, citations, chunks, cells):
    got = support.structured_support(
        spark.createDataFrame(claims, "claim_id int, statement string, subjects array<string>"), spark.createDataFrame(citations, "claim_id int, chunk_id string"), spark.createDataFrame(chunks, "chunk_id string, text string"),
        spark.createDataFrame(cells, "chunk_id string, entity_key string, metric_slug string, period_key string, canonical double"), spark.createDataFrame(MEASURES, MEASURE),
    )
    return sorted(((r.claim_id, r.kind.split("-")[0], r.what, r.period) for r in got.collect()), key=str)


def test_support_of_numbers_and_periods(spark):
    cells = [("c1", "tower", "cap", "2023", 0.0525), ("c1", "tower", "noi", "2023", 4e6), ("c2", "other", "noi", "2022", 9e6), ("c3", "tower", "noi", "undated", None)]
    chunks = [("c1", "tower 5.25 4 000 000"), ("c2", "other 777 sheep"), ("c4", "In Q2 2021 the area was 1,000 sf; 777 sheep"), ("c5", None)]
    claims = [
        (1, "The cap rate of the tower is 5.25% in 2023", ["tower"]), (2, "The cap rate is 5.25 in March 2023", ["tower"]), (3, "The cap rate is 5.25% in 2021", ["tower"]), (4, "Net income is $4.03 million", ["tower"]), (5, "Net income is $4.1 million", ["tower"]),
        (6, "Net income is $4 million", ["other"]), (7, "The area is 1,005 sf in May 2021", ["tower"]), (8, "There are 777 sheep", ["tower"]), (9, "There are 777 sheep", ["tower"]), (10, "There are ٣ sheep", []), (11, "Nothing", None), (12, "Net income is $4 million", ["tower"]), (13, None, []),
    ]
    citations = [(i, "c1") for i in range(1, 7)] + [(7, "c4"), (8, "c2"), (9, "c1"), (10, "c4"), (11, "c5"), (1, "c1")]
    assert supported(spark, claims, citations, chunks, cells) == sorted([
        (3, "numeric", 0.0525, None), (3, "period", None, "2021"), (5, "numeric", pytest.approx(4.1e6), None), (6, "numeric", 4e6, None), (9, "numeric", 777.0, None), (10, "numeric", None, None), (12, "numeric", 4e6, None),
    ], key=str)
    assert supported(spark, claims[:0], citations, chunks, cells) == []


def test_atoms(spark):
    claims = spark.createDataFrame([("1", "rent rose and area fell"), ("2", "rent rose"), ("3", "rent rose"), ("4", "rent rose")], "claim_id string, statement string")
    atoms = spark.createDataFrame([("1", "1a", "rent rose"), ("1", "1b", "area fell"), ("2", "2a", "rent"), ("4", "4a", "rent rose")], "claim_id string, atom_id string, atom string")
    got = {r.claim_id: (r.verdict, r.reason) for r in support.atom_verdicts(claims, atoms, spark.createDataFrame([("1b",), ("4",)], "id string")).collect()}
    assert got == {"1": ("dropped", "atom-unsupported"), "2": ("survived", "not-covered"), "3": ("survived", "not-covered"), "4": ("dropped", "whole")}


def test_outcomes(spark):
    rows = [("q", "answered", False, 2, "t", "c", "e", "s"), ("h", "insufficient_evidence", True, 0, None, None, "e", None), ("a", "insufficient_evidence", False, 0, None, None, "e", None), ("d", "other", True, 3, "t", None, None, None), ("t", "answered", False, 1, "t", None, None, "s"), ("n", "answered", False, 0, "t", None, None, "s"), ("s", "answered", False, 1, None, None, None, "s"), ("o", "answered", False, 1, None, None, "e", None)]
    got = {r.answer_id: (r.outcome[:4], r.conflict_id) for r in support.final_outcomes(spark.createDataFrame(rows, "answer_id string, drafted string, hint boolean, n_survived int, touched_conflict string, by_cell string, by_entity string, taken_side string")).collect()}
    assert got == {"q": ("conf", "c"), "h": ("conf", "e"), "a": ("insu", None), "d": ("othe", None), "t": ("conf", "t"), "n": ("insu", None), "s": ("conf", "s"), "o": ("answ", None)}


def test_either_side(spark):
    claims = spark.createDataFrame([(1, "rent is 5 or 6"), (2, "rent is 6"), (3, None)], "claim_id int, statement string")
    cited = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "claim_id int, chunk_id string")
    values = spark.createDataFrame([("k2", "b", 6.0), ("k1", "a", 5.0)], "conflict_id string, chunk_id string, value double")
    assert [tuple(r) for r in support.either_side(claims, cited, values).collect()] == [(1, "k1")]


@pytest.mark.parametrize(("text", "wanted"), [
    ('Kestrel Point Holdings, LLC (the "Borrower") signed.', (["Kestrel Point Holdings, LLC", "Point Holdings, LLC", "Holdings, LLC", "LLC"], ["Borrower", "the Borrower"])), ("It closed. Tower One (“Tower”)", (["Tower One", "One"], ["Tower"])), ('Acme (the "lower case")', None), ('Acme ("A" and "B")', None),
    ('Acme (see (the "Term"))', None), ('("Term")', None), ('Acme ("One two three four five six")', None), ("", None), ('Acme (the "Term', None),
])
def test_defined_terms(text, wanted):
    got = aliases.definitions_in(text)
    assert [([n for n, _ in s], a) for s, a in got] == ([wanted] if wanted else [])
    assert all(q in text for s, _ in got for _, q in s)


def test_harvested_aliases(spark):
    texts = spark.createDataFrame([(1, 'The lender of Tower One LLC (the "Borrower") agreed.'), (2, 'Twin Hall ("Hall")'), (3, None), (4, "no bracket"), (5, 'Unknown Co (the "Seller")')], "text_id int, text string")
    registry = spark.createDataFrame([("tower one llc", "tower one llc"), ("hall a", "twin hall"), ("hall b", "twin hall"), ("llc x", "llc")], "canonical_name string, alias string")
    got = sorted((r.text_id, r.alias, r.canonical_name) for r in aliases.harvested_aliases(texts, registry).collect())
    assert got == [(1, "Borrower", "tower one llc"), (1, "the Borrower", "tower one llc")] and aliases.harvested_aliases(texts.limit(0), registry).count() == 0


def test_ledger_claims(spark):
    schema = "fact_id string, entity string, measure string, amount double, unit string, raw_text string, chunk_id string, from_cell boolean"
    long = "x" * 400 + " cap rate of the tower 5.25 percent " + "y" * 400
    rows = [("a", "tower", "cap rate", 5.25, "percent", "cap rate of the tower 5.25", "c1", False), ("b", "tower 9", "cap rate", 5.25, "percent", "cap rate of the tower 5.25", "c1", False), ("c", "tower", "cap rate", 5.25, "percent", "nowhere cap rate tower 5.25", "c1", False), ("d", "tower", "cap rate", 1.0, "x", "t", "none", True), ("e", "tower", "cap rate", 5.25, "percent", "sheep eat grass 5.25", "c2", False)]
    chunks = spark.createDataFrame([("c1", "first\n" + long + "\nlast"), ("c2", "sheep eat grass 5.25")], "chunk_id string, text string")
    got = {r.fact_id: r for r in answers.ledger_claims(spark.createDataFrame(rows, schema), chunks).collect()}
    assert got["a"].statement == "tower: cap rate is 5.25 percent." and got["a"].quote in long and len(got["a"].quote) == 300 and "5.25" in got["a"].quote
    assert {k: r.fault for k, r in got.items()} == {"a": None, "b": "ambiguous-statement", "c": "quote-not-found", "d": "chunk-not-found", "e": "quote-unrelated"}


def test_attestations_do_not_depend_on_order(spark):
    rng = random.Random(1)
    cited = [(1, v, f"f{v}") for v in range(6)]
    facts = spark.createDataFrame([(f"x{v}", f"f{v}", "m") for v in range(6)], "fact_id string, chunk_id string, metric_slug string")
    conflicts = spark.createDataFrame([("k", ["x1"], "resolved"), ("j", ["x2"], "open")], "conflict_id string, fact_ids array<string>, status string")
    before = spark.createDataFrame([(2, "old")], "answer_id int, content_hash string")
    hashes = set()
    for _ in range(2):
        rng.shuffle(cited)
        r = answers.attestations(spark.createDataFrame(cited + [(2, 9, "none")], "answer_id int, document_version_id int, chunk_id string"), facts, conflicts, before).orderBy("answer_id").collect()
        hashes.add(r[0].content_hash)
        assert (r[0].n_versions, r[0].resolutions, r[0].first_hash == r[0].content_hash, r[1].first_hash, r[1].facts) == (6, "k", True, "old", "")
    assert len(hashes) == 1
