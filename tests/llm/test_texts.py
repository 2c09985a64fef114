import random
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm.languages import classified, content, fit, fit_on, label_languages, language_stretches, read_stretches, sample_sentences, sentences, unlabelled_languages
from ledgerloom.llm.leaks import Passages, agrees, edits_within, find_in, find_leaks, marks_between, plain_words, shared_run
from ledgerloom.llm.packing import best_fit_decreasing, local_search, pack, pack_documents, pack_items
from ledgerloom.llm.segmentation import oversized, split_paragraphs, split_text
from ledgerloom.llm.tokens import TOKENIZER, counter


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n,é漢\U0001f600"), max_size=900))
def test_pieces_cover_the_text(text):
    pieces = split_text(text, 100, 20)
    assert [p for p in pieces if p[1] - p[0] > 100] == [] and (not text) == (not pieces)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)


def test_cuts_fall_where_the_topic_changes():
    a, b = "The rent of the tower rose again this year. ", "Pigeons and gulls nest upon these cliffs. "
    text = a * 8 + b * 8
    first = split_text(text, 500, 40)[0]
    assert abs(first[1] - len(a) * 8) <= len(b)


def test_paragraphs(spark):
    long = "A sentence of some length stands here. " * 40
    p = spark.createDataFrame([(1, 1, "  " + long + "\n", ["H"]), (1, 1, "  " + long + "\n", ["H"]), (1, 2, "x" * 1200 + " ", None), (1, 3, None, None), (1, 4, "", None), (1, 5, "y" * 1201, None)], "document_version_id bigint, paragraph_index int, text string, heading_path array<string>").selectExpr("*", "1 AS n_pieces")
    assert sorted(map(tuple, oversized(p).collect())) == [(1, 1), (1, 5)]
    rows = split_paragraphs(p).collect()
    assert {r.paragraph_index for r in rows} == {1, 2, 5} and max(len(r.text) for r in rows) <= 1200 and oversized(p.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_packing_is_valid(sizes):
    bins = pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(best_fit_decreasing(sizes, 100))


def test_local_search_empties_containers():
    rng = random.Random(4)
    sizes = [rng.randint(25, 55) for _ in range(300)]
    first = best_fit_decreasing(sizes, 100)
    assert len(local_search([list(b) for b in first], sizes, 100)) < len(first)


def test_sizes_that_do_not_combine_stay_in_their_shards(spark):
    # 1,100 to 1,900 of 2,048: no two fit together, so nothing may go up to a single last task, and no container is shared.
    rng = random.Random(3)
    rows = [(i, rng.randint(1100, 1900)) for i in range(600)] + [(1000 + i, 2048) for i in range(200)]
    got = pack_items(spark.createDataFrame(rows, "item bigint, size int"), 2048, shard=64).collect()
    assert len(got) == len({r.container for r in got}) == 800
    mixed = [(i, rng.choice([300, 512, 700, 1024, 1100])) for i in range(3000)]
    got = pack_items(spark.createDataFrame(mixed, "item bigint, size int"), 2048, shard=128).collect()
    fills = Counter()
    for r in got:
        fills[r.container] += r.size
    assert sorted((r.item, r.size) for r in got) == mixed and max(fills.values()) <= 2048
    assert len(fills) <= 1.02 * len(pack([n for _, n in mixed], 2048))


def test_items_and_documents(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, None, 5, 700, 2048, 2049, 9000])) for i in range(400)]
    got = pack_items(spark.createDataFrame(rows, "item bigint, size int"), 2048, shard=64).collect()
    fills, cover = Counter(), {}
    for r in got:
        fills[r.container] += r.size
        cover.setdefault(r.item, []).append((r.start, r.size))
    assert max(fills.values()) <= 2048 and len(cover) == 400
    for item, size in rows:
        at = 0
        for start, n in sorted(cover[item]):
            assert start == at
            at += n
        assert at == (size or 0) and (len(cover[item]) == 1 or size > 2048)
    d = spark.createDataFrame([(1, "a  b\n\n c"), (1, "a  b\n\n c"), (2, None), (3, ""), (4, "word " * 9000)], "doc_id bigint, text string").selectExpr("*", "1 AS size", "2 AS item")
    docs = pack_documents(d).collect()
    assert Counter(r.doc_id for r in docs)[4] > 1 and {r.doc_id for r in docs} == {1, 2, 3, 4} and pack_documents(d.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 .'\n\té漢 "), max_size=60))
def test_token_counts_equal_the_tokenizer(text):
    c = counter(TOKENIZER)
    assert c(text) == len(c.encoding.encode_ordinary(text))


ITEM = "Arrears of $29.01 million piled up behind Ilmarwell Leasing Services Inc., because Thurnagate Harbor Terminal lacked permits until 26-Sep-2022, with 42 keys & locks still missing"


def test_leaks_against_brute_force():
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("rent", "tower", "lease", "market", "owner", "report") for b in ("", "s", "ing", "al", "er")]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(60))) for n in range(12)]
    texts = []
    for n in range(60):
        noise = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        length, (_, source) = rng.randint(8, 30), rng.choice(items)
        at, words = rng.randint(0, 30), source.split()
        noise[rng.randint(0, len(noise)) : 0] = words[at : at + length]
        texts.append((n, " ".join(noise)))
    p = Passages(items)
    found = {(d, i): n for d, i, n, *_ in find_in(texts, p, 15)}
    want = {}
    for d, text in texts:
        seen = plain_words(text)
        for k, (i, _) in enumerate(items):
            best = max(shared_run(p, k, seen, a, b)[0] for a in range(60) for b in range(len(seen)) if agrees(p.words[k][a], seen[b]))
            if best >= 15:
                want[(d, i)] = best
    assert found.keys() <= want.keys() and len(found) >= 0.97 * len(want)


@pytest.mark.parametrize(("text", "n"), [
    (ITEM.upper(), 26), (ITEM.replace("piled", "p1led").replace("permits", "permifs"), 26), ("x " + ITEM.replace("Services", "Serv-\nices").replace(" ", "\n> "), 26), (" ".join(f"<i>{w}</i>" for w in ITEM.split()), 26), (ITEM.replace("42", "43"), 20), (" ".join(ITEM.split()[:14]), None), ("", None), (None, None),
])
def test_leaks_in_other_dress(text, n):
    assert [r[2] for r in find_in([(1, text)], Passages([(7, ITEM)]), 15)] == ([n] if n else [])


def test_words_without_letters_at_the_ends_of_a_run_count():
    words = [f"word{i}{'abcdefghijklmnop'[i % 16]}" for i in range(60)]
    item = " ".join([*words[:20], "&", *words[20:34], "&", *words[34:]])  # the 15th of words[20:34] and a mark beside it
    p = Passages([(1, item)])
    run = [n for _, _, n, *_ in find_in([(1, "x y " + " ".join(["&", *words[20:34]]) + " z")], p, 15)]
    assert run == [15] and marks_between("a & b\n– c") == [0, 1, 1, 0]
    assert [r for r in find_in([(1, "x y & " + " ".join(words[20:34]) + " & z")], p, 15)][0][2] == 16
    assert not list(find_in([(1, "x y " + " ".join(words[20:34]) + " z")], p, 15))


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(0, 6))
def test_edits_in_a_band_are_exact(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    assert edits_within(a.encode(), b.encode(), most) == min(row[-1], most + 1)


def test_leaks_of_the_least_length_with_lost_and_added_letters():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(4, 9))) for _ in range(2000)]
    items = [(n, " ".join(rng.sample(words, 40))) for n in range(20)]
    texts = []
    for n in range(400):
        at, run = rng.randint(0, 25), items[n % 20][1].split()
        run = run[at : at + 15]
        for k in rng.sample([k for k in range(3, 12) if len(run[k]) >= 5], 2):
            run[k] = run[k][:2] + run[k][3:] if n % 2 else run[k][:3] + "x" + run[k][3:]
        texts.append((n, " ".join(rng.sample(words, 40 + n % 5) + run + rng.sample(words, 40))))
    found = {r[:2] for r in find_in(texts, Passages(items), 15)}
    assert len(found & {(n, n % 20) for n in range(400)}) >= 0.9 * 400


def test_leaks_in_spark(spark):
    d = spark.createDataFrame([(1, "a " * 5000 + ITEM), (1, "a " * 5000 + ITEM), (2, None), (3, "")], "doc_id bigint, text string").selectExpr("*", "0 AS n_words", "0 AS item_id")
    i = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, "")], "item_id bigint, text string")
    assert [tuple(r)[:3] for r in find_leaks(d, i).collect()] == [(1, 7, 26)]
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


SENTENCES = {
    "en": ["the tenant pays its share of the taxes and of the insurance", "we could not find the area that the brochure states", "the lender wants a current list of all the rents"],
    "de": ["der Mieter zahlt seinen Anteil an den Steuern und an der Versicherung", "wir konnten die Fläche nicht finden, die der Prospekt nennt", "die Bank verlangt eine aktuelle Liste aller Mieten"],
    "es": ["el inquilino paga su parte de los impuestos y del seguro", "no pudimos encontrar la superficie que indica el folleto", "el banco exige una lista actual de todas las rentas"],
}


def test_languages():
    m = fit({k: Counter(v * 5 + SENTENCES["en"][:1]) for k, v in SENTENCES.items()})
    held_out = {"en": "they asked whether the owner would share the cost of the new roof", "de": "sie fragten, ob der Eigentümer die Kosten für das neue Dach mit ihnen teilt", "es": "preguntaron si el propietario compartiría el coste del nuevo tejado"}
    assert {k: m.classify(content(v))[0] for k, v in held_out.items()} == {k: k for k in held_out}
    text = "The tenant pays its share of the taxes and of the insurance. Der Mieter zahlt seinen Anteil an den Steuern und an der Versicherung.\n\n12 | 34 | 5.6\n13 | 35 | 7.8\n\nAcme Inc. and Co."
    got = read_stretches(text, m.classify)
    assert [s[2] for s in got] == ["en", "de"] and got[0][0] == 0 and got[-1][1] == len(text) and got[0][1] == got[1][0] and [s[4] for s in got] == [1, 1]
    assert len(sentences("Acme Inc. sold it. Am 5. Mai kam er. Next.")) == 3 and sentences("") == [] and list(classified("", m.classify)) == []


def test_the_sentence_after_a_table_is_read():
    m = fit({k: Counter(v * 5) for k, v in SENTENCES.items()})
    german, english = "Der Mieter zahlt seinen Anteil an den Steuern und an der Versicherung.", "The tenant pays its share of the taxes and of the insurance."
    text = f"{german}\n\n| item | the rent of it |\n|---|---|\n| of the roof | 34 |\n{english}\n| a | b |\n"
    got = read_stretches(text, m.classify)
    assert [(s[2], s[4]) for s in got] == [("de", 1), ("en", 1)] and got[1][0] == text.index(english) and got[0][1] == got[1][0] and got[-1][1] == len(text)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="the test tables are not here")
def test_no_common_sentence_is_misread_whatever_the_sample(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    whole = sample_sentences(documents, 10**9, 10**9)
    share = {k: 1 / c.total() for k, c in whole.items()}
    clear = {t: k for k, c in whole.items() for t, n in c.items() if n >= 5 and all(j == k or n * share[k] > 3 * o[t] * share[j] for j, o in whole.items())}
    assert len(clear) > 400
    for salt in range(20):
        m = fit(sample_sentences(documents, 400, salt=salt))
        assert [(salt, t, k) for t, k in clear.items() if m.classify(t)[0] != k] == []


def test_a_sample_under_wrong_labels():
    rng = random.Random(5)
    words = {k: [w for s in v for w in s.split()] for k, v in SENTENCES.items()}
    sample = {k: Counter() for k in SENTENCES}
    for k in SENTENCES:
        for _ in range(200):
            label = k if rng.random() < 0.85 else rng.choice(sorted(SENTENCES))
            sample[label][" ".join(rng.choices(words[k], k=9))] += 1
    m = fit(sample)
    held_out = [(k, " ".join(rng.choices(words[k], k=9))) for k in SENTENCES for _ in range(100)]
    assert sum(m.classify(t)[0] == k for k, t in held_out) >= 297 and fit({"en": Counter(SENTENCES["en"])}).classify(SENTENCES["en"][0])[0] == "en"


def test_languages_in_spark(spark):
    rows = [(i, ". ".join(s.capitalize() for s in v) + ".", k) for i, (k, v) in enumerate(sorted(SENTENCES.items()) * 6)]
    rows += [(100, rows[0][1], "en-GB"), (101, rows[1][1], None), (102, None, "de"), (103, "", "n/a"), (104, rows[0][1], "Deutsch")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = fit_on(d)
    assert sorted(map(tuple, unlabelled_languages(d, m).where("doc_id > 99").collect())) == [(100, "de"), (101, "en")]
    labels = spark.createDataFrame([("en_GB",), ("Deutsch",), ("fra",), ("und",), (None,), ("pt-BR",), ("en/de",), ("??",), ("mis",)], "l string").select(label_languages(F.col("l")).alias("x"))
    assert [r.x for r in labels.collect()] == [["en"], ["de"], ["fr"], [], [], ["pt"], ["de", "en"], [], []]
    assert language_stretches(d.limit(0), fit_on(d.limit(0))).count() == 0 and language_stretches(d, fit_on(d.limit(0))).where("lang IS NOT NULL").count() == 0
