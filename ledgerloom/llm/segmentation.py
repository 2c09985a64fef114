"""Cutting long texts into pieces at natural boundaries, by lexical cohesion.

Between any two sentences (or lines) the words of a block before and of a block after are compared; where the similarity
has a valley the topic changes.  Each piece ends at the deepest valley inside its size window; where a window holds no
such boundary, at a clause, then at white space, and only then inside a word.  The next piece starts about ``overlap``
characters before the cut.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require

LIMIT, OVERLAP = 1200, 120
BLOCK = 3  # sentences on each side of a boundary that are compared
SHORTEST = 0.4  # a piece ends in the last 60 % of its window, if there is a boundary

#: White space of any kind at the ends of a text, as a Java regular expression.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

_BREAK = re.compile(r"\n+\s*|(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\W\d_]*[^\W\d_a-zà-öø-ÿ]|[\d\"'“‘«(\[])|(?<=[。！？])")
_CLAUSE = re.compile(r"(?<=[,;:|–—])\s+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]{3,}")


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    shared = sum(n * b[w] for w, n in a.items() if w in b)
    return shared / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def boundary_depths(text: str) -> tuple[list[int], list[float]]:
    """The places between sentences or lines (where the next one starts), and how deep a valley each is."""
    places = [m.end() for m in _BREAK.finditer(text) if 0 < m.end() < len(text)]
    if not places:
        return [], []
    bounds = [0, *places, len(text)]
    bags = [Counter(w.lower() for w in _WORD.findall(text, a, b)) for a, b in zip(bounds, bounds[1:])]
    similar = []
    left, right = Counter(), Counter()
    for bag in bags[1 : 1 + BLOCK]:
        right.update(bag)
    for i in range(1, len(bags)):  # boundary i lies before bag i
        left.update(bags[i - 1])
        if i - 1 - BLOCK >= 0:
            left.subtract(bags[i - 1 - BLOCK])
            left += Counter()
        similar.append(_cosine(left, right))
        right.subtract(bags[i])
        right += Counter()
        if i + BLOCK < len(bags):
            right.update(bags[i + BLOCK])
    depths = []
    for i, s in enumerate(similar):
        a = i
        while a > 0 and similar[a - 1] >= similar[a]:
            a -= 1
        b = i
        while b + 1 < len(similar) and similar[b + 1] >= similar[b]:
            b += 1
        depths.append((similar[a] - s) + (similar[b] - s))
    return places, depths


def _start_of_next(text: str, begin: int, cut: int, overlap: int) -> int:
    """Where the next piece starts: at a word about ``overlap`` characters before the cut, always after ``begin``."""
    want = cut - overlap
    near = [m.end() for m in _SPACE.finditer(text, max(begin + 1, want - 40), min(cut, want + 40)) if begin < m.end() < cut]
    return min(near, key=lambda p: (abs(p - want), p)) if near else max(begin + 1, want)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece, in characters of ``text``.  Every piece has at most ``limit`` of them; together they
    cover the text without gaps; a text within the limit is one piece, an empty one is none.
    """
    if limit <= 2 * overlap:
        raise ValueError("the limit must be more than twice the overlap")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    places, depths = boundary_depths(text)
    pieces, begin, at = [], 0, 0
    while n - begin > limit:
        low, high = begin + max(2 * overlap, int(limit * SHORTEST)), begin + limit
        while at < len(places) and places[at] <= low:
            at += 1
        end, deepest, i = 0, -1.0, at
        while i < len(places) and places[i] <= high:
            if depths[i] >= deepest:  # the later of equally deep ones
                end, deepest = places[i], depths[i]
            i += 1
        for pattern in (_CLAUSE, _SPACE):
            if not end:
                end = max((m.end() for m in pattern.finditer(text, low, high)), default=0)
        end = end or high
        pieces.append((begin, end))
        begin = _start_of_next(text, begin, end, overlap)
        at = 0 if at and places[at - 1] > begin else at
    pieces.append((begin, n))
    return pieces


_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_PIECES_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _splitter(limit: int, overlap: int):
    @F.arrow_udf(_PIECES)
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [{"start": a, "end": b} for a, b in split_text(t, limit, overlap)] for t in texts.to_pylist()], _PIECES_ARROW)

    return split


def split_paragraphs(paragraphs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every paragraph: document_version_id, paragraph_index, piece_no, n_pieces, start, end, text, heading_path.

    Surrounding white space is no part of a text; null and blank texts have no pieces.  Paragraphs stored several times
    count once.  Only texts above the limit leave the JVM.
    """
    require(paragraphs, "document_version_id", "paragraph_index", "text", "heading_path")
    body = (
        paragraphs.select("document_version_id", "paragraph_index", "heading_path", F.regexp_replace("text", EDGES, "").alias("_body"))
        .where("_body <> ''").dropDuplicates(["document_version_id", "paragraph_index"])
    )
    long = F.when(F.length("_body") > limit, F.col("_body"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("_body").alias("end")))
    cut = body.withColumn("_cut", _splitter(limit, overlap)(long)).withColumn("_cut", F.coalesce("_cut", whole))
    return cut.select("*", F.posexplode("_cut").alias("_no", "_p")).select(
        "document_version_id", "paragraph_index", (F.col("_no") + 1).alias("piece_no"), F.size("_cut").alias("n_pieces"),
        F.col("_p.start").alias("start"), F.col("_p.end").alias("end"),
        F.substring("_body", F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start")).alias("text"), "heading_path",
    )


def oversized(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs that come out in several pieces: document_version_id, paragraph_index."""
    return split_paragraphs(paragraphs).where("n_pieces > 1").select("document_version_id", "paragraph_index").distinct()
