import itertools
import json
import random

import pytest

from ledgerloom.llm.edits import NearWords, abbreviates, osa
from ledgerloom.llm.mapping import OTHER_WORDINGS, THRESHOLD, UNMATCHED, Reference, free_metrics, map_to_reference
from ledgerloom.llm.names import _bands, bands_for, candidate_pairs, form_of, link_names, linked_pairs, same_name, star_clusters


def test_near_words_equal_a_scan():
    rng = random.Random(2)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 12))) for _ in range(200)}
    allowed = lambda n: 0 if n <= 2 else 1 if n <= 9 else 2
    near = NearWords(sorted(words), allowed)
    for _ in range(200):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        assert near.near(w) == {v: d for v in words if (d := osa(w, v, 9)) <= allowed(len(v)) and abs(len(w) - len(v)) <= allowed(len(v))}
    assert abbreviates("bldg", "building") and not abbreviates("gb", "building") and osa("ab", "ba", 2) == 1


@pytest.mark.parametrize(("a", "b", "same"), [
    ("Fenlominster CPL", "Fenlominster Capital Partners LLC", True), ("Yamfolwick HAOL", "Yamfolwick Heights Apartments Owner LLC", True), ("Bramomere Logistics Center", "Bramomere Logistics Center Owner LLC", False),
    ("Lophirgate Retail Village I", "Lophirgate Retail Village II", False), ("Wolbrawell Logistics Centre Two", "Wolbrawell Logistics Center II", True), ("Zorvanewick Tower", "Zorvanewick Tower I", False),
    ("Distribution Warehouse, Celdicrest", "Celdicerest Distr. Whse", True), ("Paco Mortaqlund", "Mortaqlund, Francisco", True), ("E. Ilmarmann", "Elizabeth Ilmarmann", True), ("Edward Ilmarmann", "Elizabeth Ilmarmann", False),
    ("Halvengate Plaza", "Halvendale Plaza", False), ("Ostradale + Bros. Insurance Company", "Ostradale & Brothers Insurance Company", True), ("THE Nebri-sgate  Tower", "Nebrisgate Twr.", True), ("Quornford Dev. Corp.", "Quornford Development Corporation", True),
    ("Halvendale Office Campus", "Halvendale Corporate Square", False), ("Crullomere Asset Management", "Crullomere Asset Management GmbH", True),
])
def test_same_names(a, b, same):
    assert (form_of(a) == form_of(b) or same_name(form_of(a), form_of(b))) == same


@pytest.mark.parametrize("text", ["", " ", "n/a", "same as above", "(blank)", "Unknown", "see cover"])
def test_fill_in_words_are_no_names(text):
    assert form_of(text) is None


def test_collision_curve():
    for s, r in itertools.product((0.4, 0.5, 0.7), (1, 2, 3)):
        b = bands_for(s, r, 0.99)
        assert 1 - (1 - s**r) ** b >= 0.99 > 1 - (1 - s**r) ** (b - 1)


def test_stars(spark):
    nodes = spark.createDataFrame([(n, 1) for n in range(1, 8)], "node bigint, weight bigint")
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (4, 5), (5, 6)], "a bigint, b bigint")
    got = {r.node: r.centre for r in star_clusters(nodes, edges).collect()}
    assert got[2] == got[3] == got[4] == 1 and got[5] == got[6] and got[7] == 7


def test_no_join_of_names_is_broadcast(spark):
    forms = spark.createDataFrame([(1, 1, '["n","abcdef",[],0,false]', ["n0"]), (2, 1, '["n","abcdeg",[],0,false]', ["n0"])], "node bigint, _g bigint, _form string, _shapes array<string>")
    pairs = candidate_pairs(forms)
    facts = spark.createDataFrame([(1, "Halvengate Plaza", "The Halvengate Plaza")], "source_id bigint, entity_quote string, entity string")
    linked = linked_pairs(facts)
    for df in (pairs, link_names(facts, "source_id", "entity"), linked):
        assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)] and [tuple(r) for r in linked.collect()] == [(1, "Halvengate Plaza", "The Halvengate Plaza")]


def test_linking(spark):
    rows = [(1, "Quelfimere Tower", "Qnuelfimere Tower"), (1, "Quelfimere Tower", "the  Quelfimere\xa0Tower"), (1, "Quelfimere Plaza", "n/a"), (2, "Quelfimere Twr.", None), (None, "Nebrisgate Tower", "Nebrisgate TOWER"), (1, "", "x" * 20_000)]
    f = spark.createDataFrame(rows, "source_id bigint, entity_quote string, entity string").selectExpr("*", "1 AS node", "2 AS weight")
    got = sorted(map(tuple, linked_pairs(f).where("source_id IS NOT NULL").collect()))
    names = ["Quelfimere Tower", "Qnuelfimere Tower", "the  Quelfimere\xa0Tower"]
    assert got == sorted((1, *sorted(p)) for p in itertools.combinations(names, 2))
    assert linked_pairs(f.limit(0)).count() == 0 and link_names(f.selectExpr("source_id", "CAST(NULL AS string) AS name"), "source_id", "name").count() == 0


REFERENCE = {"going_in_yield": ["going_in_yield", "Going-in Yield", "entry yield"], "exit_yield": ["exit_yield", "Exit Yield"], "market_rent_rate": ["Market Rent Rate", "erv"], "storage_area": ["Storage Area"], "loan_principal": ["Outstanding Loan Principal"], "purchase_consideration": ["Purchase Consideration"]}


@pytest.mark.parametrize(("value", "entry"), [
    ("Gng-n Yield", "going_in_yield"), ("YIELD, GOING-IN", "going_in_yield"), ("GoingInYield", "going_in_yield"), ("goinginyield", "going_in_yield"), ("Going-ni Yield", "going_in_yield"), ("goin gin yield", "going_in_yield"), ("Anfangsrendite", "going_in_yield"),
    ("rendement de sortie", "exit_yield"), ("exit yiedl (est.)", "exit_yield"), ("Prchs Cnsdrtn", "purchase_consideration"), ("O/S Loan Princ.", "loan_principal"), ("erv [1]", "market_rent_rate"), ("market gossip", UNMATCHED), ("storage of minutes", UNMATCHED), ("x" * 20_000, UNMATCHED), ("?", UNMATCHED),
])
def test_mapping(value, entry):
    r = Reference({k: [*v, *OTHER_WORDINGS[k]] for k, v in REFERENCE.items()})
    assert r.map(value, THRESHOLD)[0] == entry


def test_a_long_list_is_mapped_in_blocks(spark):
    wordings = {k: [*v, *OTHER_WORDINGS[k]] for k, v in REFERENCE.items()}
    values = ["Gng-n Yield", "exit yiedl", "rendement de sortie", "market gossip", "O/S Loan Princ.", "yield", None, " "]
    df = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    whole = {r.n: (r.entry, r.score) for r in map_to_reference(df, "v", wordings).collect()}
    blocks = {r.n: (r.entry, r.score) for r in map_to_reference(df, "v", wordings, block=2).collect()}
    assert {n: e for n, (e, _) in whole.items()} == {n: e for n, (e, _) in blocks.items()} and blocks[1] == whole[1] and blocks[6] == (None, None)


def test_swapped_neighbours_share_a_band(spark):
    cores = ["abcde", "abdce", "nebris", "nebrsi"]
    df = spark.createDataFrame([(i, json.dumps(["n", c, [], 0, False])) for i, c in enumerate(cores)], "i int, f string")
    bands = {r.i: set(r.b) for r in df.select("i", _bands("f").alias("b")).collect()}
    assert bands[0] & bands[1] and bands[2] & bands[3] and not bands[0] & bands[2]


def test_free_metrics(spark):
    m = spark.createDataFrame([(k, v[-1], v[:-1]) for k, v in REFERENCE.items()], "slug string, label string, aliases array<string>")
    f = spark.createDataFrame([("a", " ENTRY yield "), ("b", "entyr yield"), ("b", "entyr yield"), ("c", None), ("d", " "), ("e", "pigeons sighted")], "fact_id string, metric string").selectExpr("*", "'x' AS entry", "1 AS score")
    assert sorted(map(tuple, free_metrics(f, m).collect())) == [("b", "going_in_yield"), ("e", UNMATCHED)]
    assert free_metrics(f.limit(0), m).count() == 0 and {r.slug for r in free_metrics(f, m.limit(0)).collect()} == {UNMATCHED}
