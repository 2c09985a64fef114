"""Linking the variant spellings of names typed by people.

Within a group (a source) names are reduced to forms: what is left when case, accents, order, titles, articles and known
abbreviations are set aside.  Forms meet by MinHash banding over padded q-grams of their distinguishing word; the number of
bands follows from the collision curve and the wanted recall.  Candidates are verified by Monge-Elkan similarity of their
words, with what tells namesakes apart (numbers, given names, roles) as hard conditions.  Verified pairs are clustered by
star clustering: the most used form is a centre, its neighbours are its satellites, and so on with what is left.

Scale: every step is a join or aggregation on keys that spread inside a group (group, shape of the name, band).  Forms that
share their shape with no other form are set aside before banding.  Nothing is gathered per group or on the driver, and no
side of a join that grows with the input is broadcast.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require
from ledgerloom.llm.edits import NearWords, abbreviates, osa
from ledgerloom.storage import durable

# Fill-in texts that are no names.
NO_NAMES = frozenset(("", "-", "--", "?", "??", "n/a", "na", "none", "null", "nil", "unknown", "(blank)", "blank", "tbd", "tba", "same as above", "same", "ditto", "see above", "see cover", "see cover letter", "as above", "not stated", "not available", "various", "the property", "property", "tenant", "landlord", "owner", "the owner"))
# Forms of address.
TITLES = frozenset("mr mrs ms mx miss dr prof sir herr frau sr sra senor senora mme mlle monsieur madame".split())
# Given names and their short forms, the full name first.
GIVEN = (
    "alexander alex sasha sandy al xander", "andrew andy drew", "anthony tony", "benjamin ben benny", "catherine cathy", "charles charlie chuck", "christopher chris", "daniel dan danny", "david dave",
    "dorothy dot dottie dolly dora", "edward ed eddie ned ted teddy", "elizabeth liz beth betty lizzie eliza bess lisa", "francisco paco pancho fran cisco curro", "frederick fred freddie fritz freddy", "guadalupe lupe lupita", "henry harry hank",
    "james jim jimmy jamie", "johannes hans johann hannes jan", "john johnny jack", "jose pepe", "joseph joe joey", "katherine kate kathy katie kat kay kit", "margaret peggy maggie meg marge greta madge",
    "maria mia", "matthew matt", "michael mike mick mickey micky", "nicholas nick", "patricia pat patty tricia trish patsy", "peter pete", "richard rick dick richie rich ricky", "robert bob rob bobby bert robbie",
    "samuel sam", "stephen steve", "susanne sue susan susi sanne suzy susie", "theodore theo ted teddy", "thomas tom tommy", "victoria vicky", "william bill will billy willy liam",
)
# Words that say what kind of building, firm or legal form a name stands for.
BUILDING = "tower plaza building office campus business park industrial logistics center distribution warehouse shopping retail village technology corporate square medical street avenue lofts heights apartments harbor terminal".split()
FIRM = "capital partners property management real estate advisors asset investments holdings brokerage group leasing services development engineering associates national bank trust brothers insurance".split()
LEGAL = "llc inc incorporated lp llp limited ltd gmbh corporation company plc ag sa and".split()
# Short or other forms that leave letters out of order.
OTHER_FORMS = {"centre": "center", "ctr": "center", "biz": "business", "ltd": "limited", "inc": "incorporated", "+": "and", "&": "and", "und": "and", "wh": "warehouse", "xing": "crossing", "techn": "technology", "gp": "group", "sqr": "square", "hbr": "harbor", "harbour": "harbor", "trml": "terminal"}
LONG_FORMS = tuple((re.compile(form), short) for form, short in ((r"limited liability co(?:mpany)?\b\.?", "llc"), (r"limited liability partnership", "llp"), (r"limited partnership", "lp"), (r"gesellschaft mit beschrankter haftung", "gmbh")))
NUMBERS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}

_KNOWN = {w: "t" for w in BUILDING} | {w: "f" for w in FIRM} | {w: "l" for w in LEGAL}
_SHORT_OF: dict[str, list[str]] = {}
for _full, *_short in (names.split() for names in GIVEN):
    for _s in (_full, *_short):
        _SHORT_OF.setdefault(_s, []).append(_full)

Q, ROWS, RECALL, SIMILAR = 2, 2, 0.99, 0.5


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands needed so that a pair of this Jaccard similarity meets with probability ``recall``: 1 - (1 - s^rows)^bands."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


#: One letter replaced, lost or added leaves padded bigrams a similarity of one half in words of five letters, more in longer
#: ones.  Two swapped neighbours leave less; they share their sorted letters, and a band of its own (see _bands).
BANDS = bands_for(SIMILAR, ROWS, RECALL)


_NEAR_KNOWN = NearWords([w for w in _KNOWN if len(w) >= 5], lambda n: 1)
_NEAR_GIVEN = NearWords([w for w in _SHORT_OF if len(w) >= 4], lambda n: 1)
_KNOWN_BY_LETTER: dict[str, list[str]] = {}
for _w in _KNOWN:
    if len(_w) >= 4:
        _KNOWN_BY_LETTER.setdefault(_w[0], []).append(_w)


def _known_word(token: str) -> tuple[str, str, float] | None:
    """(word, kind, similarity) of the kind words a token can stand for; the closest one."""
    token = OTHER_FORMS.get(token, token)
    if token in _KNOWN:
        return token, _KNOWN[token], 1.0
    found = [(0.96, w) for w, d in _NEAR_KNOWN.near(token).items() if d == 1] if len(token) >= 4 else []
    if len(token) > 2 or token in ("av", "st", "sq", "pk", "co", "bk"):
        for w in _KNOWN_BY_LETTER.get(token[0], ()):
            if abbreviates(token, w):
                found.append(((0.95 if w.startswith(token) else 0.9) + 0.04 * len(token) / len(w), w))
    return max(((w, _KNOWN[w], round(sure, 4)) for sure, w in found), key=lambda f: (f[2], f[0]), default=None)


_known_cached = lru_cache(maxsize=100_000)(_known_word)


def _given(token: str) -> tuple[str, ...]:
    """Full given names a token can stand for (itself, what it is short for, or what it is a misspelling of)."""
    if token in _SHORT_OF:
        return tuple(_SHORT_OF[token])
    if len(token) >= 4:
        return tuple(sorted({f for s, d in _NEAR_GIVEN.near(token).items() if d == 1 for f in _SHORT_OF[s]}))
    return ()


_given_cached = lru_cache(maxsize=100_000)(_given)


def fold(text: str) -> list[str]:
    """Words of a name without case, accents, titles and articles; what stands before a comma goes to the end."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    t = re.sub(r"\s+", " ", t).strip()
    if t in NO_NAMES:
        return []
    t = re.sub(r"(?<=\w)['’](?=\w)|(?<=[a-z])-(?=[a-z])", "", t)
    for form, short in LONG_FORMS:
        t = form.sub(short, t)
    t = re.sub(r"\b(?:[a-z]\.){2,}(?=\s|,|$)|\bg\.m\.b\.h\.?", lambda m: m[0].replace(".", ""), t)
    head, comma, tail = t.partition(",")
    t = f"{tail} {head}" if comma and tail.strip() else head
    words = [w.strip(".()\"'") for w in re.split(r"[\s/;:]+", t)]
    words = [w for w in words if w and w not in TITLES]
    return words[1:] if len(words) > 1 and words[0] == "the" else words


@lru_cache(maxsize=200_000)
def form_of(text: str) -> tuple[str, str, tuple[str, ...], int, bool] | None:
    """(kind, core, other words, number, owner) of a name; None for fill-in texts.

    kind 'p' (person): core is the surname, others the given name or its initial.  kind 'n' (anything else): core is the
    word that is no kind word, others the kind words in order of the alphabet; a word that may be the initials of kind
    words is kept as '=xyz'.
    """
    words = fold(text)
    if not words:
        return None
    letters = [w for w in words if len(w) == 1 and w.isalpha() and w not in ("i", "v", "x")]
    body = [w for w in words if w not in letters] if len(words) > len(letters) else words
    # Words in capitals inside a name that is not: the initials of its kind words.
    capitals = set() if text.isupper() else {w.lower() for w in re.findall(r"\b[A-Z]{2,5}\b", text)} - set(NUMBERS) - set(LEGAL)
    acronyms = [w for w in body if w in capitals] if len(words) <= 3 else []
    body = [w for w in body if w not in acronyms]
    square = any((k := _known_cached(w)) and k[0] == "square" for w in body)
    known = {w: _known_cached(w) for w in body}
    for w in body:  # Corp. is corporate before Square, else corporation
        if known[w] and known[w][0] in ("corporate", "corporation") and known[w][2] < 1:
            known[w] = ("corporate", "t", known[w][2]) if square else ("corporation", "l", known[w][2])
    strong = [w for w in body if known[w] and known[w][1] in "tf" and known[w][2] >= 0.9 and not _given_cached(w)]
    legal = [w for w in body if known[w] and known[w][1] == "l" and w in (*LEGAL, *OTHER_FORMS)]
    numbers = [w for w in body if w in NUMBERS or w.isdigit()]
    if not body:
        return "n", words[0], tuple("=" + w for w in acronyms[1:]), 0, False
    if not strong and not legal and not numbers and not acronyms and 1 < len(words) <= 4:
        given = next((w for w in body if w in _SHORT_OF), None) or next((w for w in body if _given_cached(w)), None)
        rest = [w for w in body if w != given]
        if given and rest:
            first = "|".join(_given_cached(given))
            return "p", max(rest, key=len), (first,), 0, False
        if not given and letters and len(body) == 1:
            initial = letters[0] if words[0] in letters or len(letters) == 1 else letters[-1]
            return "p", body[0], (initial + "*",), 0, False
    if len(words) == 2 and not letters and not strong and not acronyms and not legal and not numbers and not any(known.values()):
        return "p", words[1], (words[0],), 0, False
    number = next((NUMBERS.get(w) or int(w) for w in numbers if w in NUMBERS or len(w) < 9), 0)
    free = [w for w in body if not known[w] and w not in numbers and w != "owner"]
    if not free:
        free = [max((w for w in body if w not in numbers), key=len, default=words[0])]
    core = max(free, key=lambda w: (len(w), w))
    others = sorted({known[w][0] for w in body if known[w] and w != core and w != "owner"} | {"=" + w for w in acronyms if w != core} | {w for w in free if w != core})
    return "n", core, tuple(o for o in others if o != "and"), number, "owner" in body


def shape_keys(form: tuple[str, str, tuple[str, ...], int, bool]) -> list[str]:
    """Keys of the blocks a form belongs to; two forms of one name share at least one."""
    kind, _, others, number, owner = form
    if kind == "p":
        firsts = {o[0] for first in others for o in first.split("|") if o}
        return [f"p{c}" for c in sorted(firsts)]
    tail = f"n{number}{'o' if owner else ''}"
    letters = "".join(o[1:] for o in others if o.startswith("="))
    if letters:  # with and without a last letter for the legal form; an o may be the owner's
        meant = {(number, owner, letters), (number, owner, letters[:-1])}
        meant |= {(number, True, x.replace("o", "", 1)) for _, _, x in meant if "o" in x}
        return sorted({f"n{n}{'o' if own else ''}{''.join(sorted(x))}" for n, own, x in meant if x})
    meaning = [o for o in others if _KNOWN.get(o) != "l"]
    return [tail + "".join(sorted(o[0] for o in meaning))]


_CODES = np.random.default_rng(20).permuted(np.tile(np.arange(784, dtype=np.int64), (BANDS * ROWS, 1)), axis=1)


def signature(core: str) -> np.ndarray:
    """MinHash over the padded q-grams of a word: one row per band."""
    letters = [0, *[(ord(c) - 96 if "a" <= c <= "z" else 27) for c in core], 0]
    codes = [a * 28 + b for a, b in zip(letters, letters[1:])]
    return _CODES[:, codes].min(axis=1).reshape(BANDS, ROWS)


def token_similarity(a: str, b: str) -> float:
    """1 for equal words, abbreviations and synonyms near 1, else by edits and length."""
    if a == b:
        return 1.0
    if abbreviates(a, b) or abbreviates(b, a):
        return 0.95
    return 1.0 - osa(a, b, 3) / max(len(a), len(b))


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Mean over the words of ``a`` of the best similarity to a word of ``b``; 1 if ``a`` has none."""
    return sum(max((token_similarity(x, y) for y in b), default=0.0) for x in a) / len(a) if a else 1.0


def _core_agrees(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 5 and osa(a, b, 1) == 1)


def _given_agrees(a: str, b: str) -> bool:
    xs, ys = set(a.split("|")), set(b.split("|"))
    if xs & ys:
        return True
    for x in xs:
        for y in ys:
            if x.endswith("*") or y.endswith("*"):
                if x[0] == y[0]:
                    return True
            elif len(x) > 3 and osa(x, y, 1) == 1:
                return True
    return False


MATCH = 0.9


def _initials(form: tuple[str, str, tuple[str, ...], int, bool]) -> set[str]:
    """The letters, sorted, that may stand for the kind words of a form: with and without its legal form."""
    meaning = "".join(w[0] for w in form[2] if _KNOWN.get(w) != "l") + ("o" if form[4] else "")
    legal = "".join(w[0] for w in form[2] if _KNOWN.get(w) == "l" and w != "and")
    return {"".join(sorted(meaning)), "".join(sorted(meaning + legal))}


def same_name(a: tuple[str, str, tuple[str, ...], int, bool], b: tuple[str, str, tuple[str, ...], int, bool]) -> bool:
    """Whether two forms can be spellings of one name."""
    if a[0] != b[0] or a[3] != b[3] or not _core_agrees(a[1], b[1]):
        return False
    if a[0] == "p":
        return any(_given_agrees(x, y) for x in a[2] for y in b[2])
    short_a, short_b = ("".join(w[1:] for w in f[2] if w.startswith("=")) for f in (a, b))
    if short_a or short_b:
        if short_a and short_b:
            return sorted(short_a) == sorted(short_b)
        short, rest, full = (short_a, a, b) if short_a else (short_b, b, a)
        return all(w.startswith("=") or _KNOWN.get(w) == "l" for w in rest[2]) and "".join(sorted(short)) in _initials(full)
    if a[4] != b[4]:
        return False
    x, y = (tuple(w for w in f[2] if _KNOWN.get(w) != "l") for f in (a, b))
    return len(x) == len(y) and min(monge_elkan(x, y), monge_elkan(y, x)) >= MATCH


_FORM = T.StructType([T.StructField("form", T.StringType()), T.StructField("shapes", T.ArrayType(T.StringType()))])


@F.arrow_udf(_FORM)
def _forms(names: pa.Array) -> pa.Array:
    forms, shapes = [], []
    for name in names.to_pylist():
        form = form_of(name) if name else None
        forms.append(None if form is None else json.dumps(form, ensure_ascii=True, separators=(",", ":")))
        shapes.append(None if form is None else shape_keys(form))
    return pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(shapes, pa.list_(pa.string()))], names=["form", "shapes"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bands(forms: pa.Array) -> pa.Array:
    out = []
    for text in forms.to_pylist():
        core = json.loads(text)[1]
        # One band more for swapped neighbours, which share too few q-grams in a short word: the same letters in order.
        swapped = BANDS * 784 * 784 + crc32("".join(sorted(core)).encode())
        out.append([*((i * 784 + int(a)) * 784 + int(b) for i, (a, b) in enumerate(signature(core))), swapped])
    return pa.array(out, pa.list_(pa.int64()))


@lru_cache(maxsize=100_000)
def _parsed(text: str) -> tuple[str, str, tuple[str, ...], int, bool]:
    kind, core, others, number, owner = json.loads(text)
    return kind, core, tuple(others), number, owner


@F.arrow_udf(T.BooleanType())
def _verified(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([same_name(_parsed(x), _parsed(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())


def _merged(df: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged.  Spark's size estimate leaves out what an explode multiplies and what
    compresses well in Parquet, so that it would send rows to the driver, and from there to all, that don't fit there."""
    return df.hint("merge")


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Star clustering of a weighted graph: node, centre.

    ``nodes``: node, weight.  ``edges``: a, b, each pair once (both directions are implied).  Of the nodes left, each that
    outranks all its neighbours (by number of neighbours, then weight, then node) becomes a centre and takes its neighbours;
    a neighbour of several centres goes to the highest.  Rounds go on until no node is left; nodes without edges are their
    own centres.
    """
    links = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    degrees = links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    ranked = durable(nodes.join(_merged(degrees), "node", "left"), "nodes")
    done = ranked.where("degree IS NULL").select("node", F.col("node").alias("centre"))
    left = ranked.where("degree IS NOT NULL").select("node", F.struct("degree", "weight", "node").alias("rank"))
    while not left.isEmpty():
        ranks = left.select(F.col("node").alias("b"), F.col("rank").alias("rank_b"))
        open_links = links.join(_merged(left.withColumnRenamed("node", "a")), "a").join(_merged(ranks), "b")
        top = left.join(_merged(open_links.groupBy("a").agg(F.max("rank_b").alias("rival"))), left.node == F.col("a"), "left").select("node", "rank", "rival")
        centres = top.where("rival IS NULL OR rank > rival").select("node", "rank")
        taken = (
            open_links.join(_merged(centres.select(F.col("node").alias("b"))), "b", "left_semi").groupBy(F.col("a").alias("node")).agg(F.max("rank_b").alias("best"))
            .select("node", F.col("best.node").alias("centre"))
        )
        found = durable(centres.select("node", F.col("node").alias("centre")).unionByName(taken), "stars")
        done = done.unionByName(found)
        left = durable(left.join(_merged(found), "node", "left_anti"), "nodes")
    return done


def candidate_pairs(forms: DataFrame) -> DataFrame:
    """Pairs of forms that meet in a block and a band, each once: a, b, fa, fb.  ``forms``: node, _g, _form, _shapes."""
    shaped = forms.select("node", "_form", F.explode("_shapes").alias("_s"), "_g").select("node", "_form", F.xxhash64("_g", "_s").alias("block"))
    crowded = shaped.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block")
    banded = shaped.join(_merged(crowded), "block", "left_semi").select("node", "_form", "block", F.explode(_bands("_form")).alias("band"))
    buckets = banded.select("node", "_form", F.xxhash64("block", "band").alias("bucket"))
    a, b = buckets.select("bucket", F.col("node").alias("a"), F.col("_form").alias("fa")), buckets.select("bucket", F.col("node").alias("b"), F.col("_form").alias("fb"))
    return a.join(_merged(b), "bucket").where("a < b").groupBy("a", "b").agg(F.first("fa").alias("fa"), F.first("fb").alias("fb"))


def link_names(names: DataFrame, group: str, name: str) -> DataFrame:
    """Clusters of the spellings in each group: ``group``, ``name``, ``cluster``.

    ``names`` has a row for each use of a name; how often a spelling is used decides what becomes a centre.  Null names and
    fill-in texts are in no cluster; a null group is a group of its own.  Spellings that reduce to one form are together;
    a spelling alone in its cluster is in the result too.
    """
    require(names, group, name)
    used = names.where(F.col(name).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(name).alias("_name")).agg(F.count("*").alias("_uses"))
    spelled = used.withColumn("_f", _forms("_name")).where("_f.form IS NOT NULL").select("_g", "_name", "_uses", F.col("_f.form").alias("_form"), F.col("_f.shapes").alias("_shapes"))
    spelled = durable(spelled.withColumn("node", F.xxhash64("_g", "_form")), "spellings")
    forms = durable(spelled.groupBy("node", "_g", "_form").agg(F.sum("_uses").alias("weight"), F.first("_shapes").alias("_shapes")), "forms")
    pairs = candidate_pairs(forms)
    edges = durable(pairs.where(_verified("fa", "fb")).select("a", "b"), "edges")
    stars = star_clusters(forms.select("node", "weight"), edges)
    return spelled.join(_merged(stars), "node").select(F.col("_g").alias(group), F.col("_name").alias(name), F.col("centre").alias("cluster"))


def linked_pairs(facts: DataFrame) -> DataFrame:
    """Different spellings of one entity in a source: source_id, name_a, name_b (the smaller by code point first)."""
    require(facts, "source_id", "entity_quote", "entity")
    names = facts.select("source_id", F.explode(F.array("entity_quote", "entity")).alias("name"))
    linked = durable(link_names(names, "source_id", "name"), "linked")
    a, b = linked.withColumnRenamed("name", "name_a"), linked.withColumnRenamed("name", "name_b")
    return a.join(_merged(b), ["source_id", "cluster"]).where("name_a < name_b").select("source_id", "name_a", "name_b")
