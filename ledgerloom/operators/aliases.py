"""Names that texts define for entities, and facts that passes over prose propose."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require
from ledgerloom.functions.text import alias_key, entity_fold, quote_fold

# Bounds of a defined term, of its subject and of the quote that holds both.
TERM_WORDS, TERM_CHARACTERS, SUBJECT_WORDS, QUOTE_CHARACTERS = 5, 64, 8, 640
_CLOSING = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_ARTICLE = re.compile(r"the\s+", re.IGNORECASE)
_BOUNDARY = re.compile(r"[;:()\n\r]")
_SENTENCE = re.compile(r"[.!?]\s+(?=[^\W_a-zà-ÿ])")
_EDGE = " \t\n\r,-‐‑‒–—―−"
_LEADING = re.compile(r"^[\s,;:.\-‐-―−\"'“”‘’]+")


def brackets(text: str) -> list[tuple[int, int]]:
    """(opening, closing) places of the outermost round brackets; one that is never closed hides what follows it."""
    found, depth, begin = [], 0, 0
    for m in re.finditer(r"[()]", text):
        if m[0] == "(":
            begin, depth = (m.start() if depth == 0 else begin), depth + 1
        elif depth:
            depth -= 1
            if depth == 0:
                found.append((begin, m.start()))
    return found


def defined_term(inside: str) -> tuple[str, bool] | None:
    """(term, whether it has an article) of a bracket that holds a quoted term and nothing else; None for others."""
    rest, n = _ARTICLE.subn("", inside.strip(), count=1) if _ARTICLE.match(inside.strip()) else (inside.strip(), 0)
    if len(rest) < 3 or _CLOSING.get(rest[0]) != rest[-1]:
        return None
    term = " ".join(rest[1:-1].split())
    if m := _ARTICLE.match(term):
        term, n = term[m.end() :], 1
    if not term or len(term) > TERM_CHARACTERS or len(term.split(" ")) > TERM_WORDS or not term[0].isupper() or re.search(r"[()\"'“”‘’]", term):
        return None
    return term, bool(n)


def subjects_before(text: str, at: int) -> list[tuple[str, int]]:
    """(name, start) of what may be the subject before a place: the last words of its phrase, the longest run first."""
    begin = max((m.end() for m in _BOUNDARY.finditer(text, 0, at)), default=0)
    begin = max((m.end() for m in _SENTENCE.finditer(text, begin, at)), default=begin)
    phrase = text[begin:at].rstrip(_EDGE)
    starts = [begin + m.start() for m in re.finditer(r"\S+", phrase)][-SUBJECT_WORDS:]
    names = [(" ".join(_LEADING.sub("", text[s : begin + len(phrase)]).split()), s) for s in starts]
    return [(name, s) for name, s in names if name]


def definitions_in(text: str) -> list[tuple[list[tuple[str, str]], list[str]]]:
    """(candidates as (name, quote), aliases) of each ``Subject (the "Term")`` of a text."""
    found = []
    for begin, end in brackets(text):
        if term := defined_term(text[begin + 1 : end]):
            subjects = [(name, text[s : end + 1]) for name, s in subjects_before(text, begin) if end + 1 - s <= QUOTE_CHARACTERS]
            if subjects:
                found.append((subjects, [term[0], f"the {term[0]}"] if term[1] else [term[0]]))
    return found


_DEFINED = T.ArrayType(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("quotes", T.ArrayType(T.StringType())), T.StructField("aliases", T.ArrayType(T.StringType()))]))
_DEFINED_ARROW = pa.list_(pa.struct([("names", pa.list_(pa.string())), ("quotes", pa.list_(pa.string())), ("aliases", pa.list_(pa.string()))]))


@F.arrow_udf(_DEFINED)
def _definitions(texts: pa.Array) -> pa.Array:
    rows = [None if t is None else [{"names": [n for n, _ in s], "quotes": [q for _, q in s], "aliases": a} for s, a in definitions_in(t)] for t in texts.to_pylist()]
    return pa.array(rows, _DEFINED_ARROW)


def harvested_aliases(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """Aliases that texts define for registered entities: text_id, alias, canonical_name, quote.

    ``texts``: text_id, text.  ``registry``: canonical_name, alias (folded).  Candidates for the subject are tried longest first:
    the first registered one decides, and if its name is of several entities the definition is dropped.  Only texts with a
    bracket and a quote leave the JVM.
    """
    require(texts, "text_id", "text")
    likely = texts.where(F.col("text").rlike(r"\(\s*(?i:the\s+)?[\"'“‘]"))
    found = likely.select("text_id", F.posexplode(_definitions("text")).alias("no", "d")).select("text_id", "no", "d.aliases", F.posexplode(F.arrays_zip("d.names", "d.quotes")).alias("pos", "c"))
    tried = found.select("text_id", "no", "aliases", "pos", entity_fold(F.col("c.names")).alias("alias"), F.col("c.quotes").alias("quote"))
    known = registry.groupBy("alias").agg(F.min("canonical_name").alias("canonical_name"), F.countDistinct("canonical_name").alias("n"))
    first = tried.join(known, "alias").groupBy("text_id", "no").agg(F.min(F.struct("pos", "canonical_name", "n", "quote", "aliases")).alias("f"))
    return first.where("f.n = 1").select("text_id", F.explode("f.aliases").alias("alias"), F.col("f.canonical_name").alias("canonical_name"), F.col("f.quote").alias("quote"))


def prose_candidates(candidates: DataFrame, measures: DataFrame, registry: DataFrame) -> DataFrame:
    """Facts that passes over prose proposed, checked: fact_id, pass, reason (null if the candidate stands), metric_slug, entity_key.

    ``candidates``: fact_id, pass, text, quote, entity_quote, metric, unit.  ``measures``: alias, slug, unit (one row per unit of a
    measure).  ``registry``: canonical_name, alias.  The quote must stand in the text and the entity's name in the quote, both
    verbatim (quotes, hyphens and blanks aside); metric and unit must be listed; a name of just one registered entity is
    taken for it, others stay as they are.  Reasons: quote-not-found, entity-not-in-quote, metric-not-listed, unit-not-listed.
    """
    require(candidates, "fact_id", "pass", "text", "quote", "entity_quote", "metric", "unit")
    slugs = measures.select(F.col("alias").alias("_alias"), "slug").distinct()
    units = measures.select(F.col("slug").alias("_slug"), F.col("unit").alias("_unit")).distinct()
    names = registry.groupBy(F.col("alias").alias("_name")).agg(F.min("canonical_name").alias("_canonical"), F.countDistinct("canonical_name").alias("_n")).where("_n = 1")
    c = candidates.withColumn("_alias", alias_key(F.col("metric"))).withColumn("_folded", entity_fold(F.col("entity_quote")))
    j = c.join(slugs, "_alias", "left").join(units, (F.col("slug") == F.col("_slug")) & (F.col("unit") == F.col("_unit")), "left").join(names, F.col("_folded") == F.col("_name"), "left")
    holds = lambda text, part: F.coalesce((quote_fold(part) != "") & F.contains(quote_fold(text), quote_fold(part)), F.lit(False))
    reason = (
        F.when(~holds(F.col("text"), F.col("quote")), "quote-not-found").when(~holds(F.col("quote"), F.col("entity_quote")), "entity-not-in-quote")
        .when(F.col("slug").isNull(), "metric-not-listed").when(F.col("_unit").isNull(), "unit-not-listed")
    )
    return j.select("fact_id", "pass", reason.alias("reason"), F.col("slug").alias("metric_slug"), F.coalesce("_canonical", "_folded").alias("entity_key"))
