"""The language of each document and of each of its stretches, with a confidence.

Sentences are classified by nearest centroids: TF-IDF vectors of letter n-grams, normalised, are compared by cosine with
several centroids per language; what is near none is in no language.  The centroids are fitted on a bounded sample of
labelled documents, whose wrong labels are cleaned first: a sentence stays only if it is clearly more common under its label
than under any other, and not clearly nearer to the mean of another label.  The fit is checked on its own sentences, and gets
further centroids where they are read wrongly.  Names, figures and tables are set aside before, since they are in no language.

The documents are read once and never shuffled; repeated sentences cost a dictionary look-up.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require

LANGUAGES = ("de", "en", "es", "fr", "nl", "pt")
#: The classifier is fitted on about so many labelled documents of each language, and on so many different sentences of each.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES = 1000, 4000
CENTROIDS, MOST_CENTROIDS = 24, 64  # per language: at first, and at most
CLEAR, SLACK, LEAD = 3.0, 0.08, 0.05  # see fit
BITS = 14
DIMENSIONS = 1 << BITS
_SPREAD = np.uint32(0x9E3779B1)
NEAREST, MARGIN = 0.12, 0.01  # least cosine, and least lead over the next language
WHOLE_WORDS = 4  # words that are no names and no figures, in a whole sentence

# Codes and names by which labels name the languages.
LABELS = {
    "de": "de deu ger german deutsch aleman allemand duits alemao",
    "en": "en eng english englisch anglais ingles engels",
    "es": "es spa spanish espanol castellano spanisch espagnol spaans espanhol",
    "fr": "fr fra fre french francais franzosisch frances frans",
    "nl": "nl nld dut dutch nederlands niederlandisch neerlandais holandes neerlandes flemish vlaams",
    "pt": "pt por portuguese portugues portugiesisch portugais portugees",
}
LABEL_CODE = {word: code for code, words in LABELS.items() for word in words.split()}

_END = re.compile(r"[.!?…][\"'”’»)\]]*\s+(?=[\"'“‘«(\[¿¡$]?[^\W_])|\n\s*\n|:\s*\n")
_ABBREVIATED = frozenset("Inc Ltd Corp Co Mr Mrs Ms Mx Dr St No Nr ca bzw approx vs Sr Sra Jr".split())
_OTHER = re.compile(r"[\W\d_]+")
_CLOSING = " \t\n\r\"'”’»)]"


def label_languages(label: Column) -> Column:
    """The languages a label names: by code, regional code or name; an empty array if it names none."""
    plain = F.translate(F.lower(F.coalesce(label, F.lit(""))), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    words = F.split(plain, r"[^a-z]+")
    codes = F.create_map(*[F.lit(v) for kv in LABEL_CODE.items() for v in kv])
    # In a regional code the second part is a territory: only the first part of x-YY or x_YY counts.
    regional = label.rlike(r"^\s*[A-Za-z]{2,3}[-_][A-Za-z0-9]{2,4}\s*$")
    found = F.transform(F.when(regional, F.slice(words, 1, 1)).otherwise(words), lambda w: F.try_element_at(codes, w))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of sentences, or of paragraphs that hold none; wrapped lines are joined."""
    found, begin = [], 0
    for m in _END.finditer(text):
        at, cut = m.span()
        if text[at] == "." and (before := text[max(begin, at - 8) : at].rsplit(None, 1)) and ((w := before[-1]) in _ABBREVIATED or (w.isupper() and w.title() in _ABBREVIATED) or len(w) == 1 or (len(w) == 2 and w.isdigit())):
            continue
        found.append((begin, cut))
        begin = cut
    if begin < len(text):
        found.append((begin, len(text)))
    return found


def content(sentence: str) -> str:
    """The words that can tell a language: those that start with a small letter, so neither names nor figures; of a
    sentence in capitals, all words.
    """
    words = [w for w in sentence.split() if w >= "a"]
    if len(words) < WHOLE_WORDS:
        every = sentence.split()
        capitals = sum(map(str.isupper, every))
        if capitals >= WHOLE_WORDS and capitals * 10 > 7 * len([w for w in every if not w[0].isdigit() and w[0] not in "$€£("]):
            return sentence.lower()
    return " ".join(words)


def grams(text: str) -> np.ndarray:
    """The dimensions of the letter n-grams (1 to 4, words padded by blanks) of a text, one for each occurrence."""
    plain = f" {text} "
    if not plain.isascii() or not plain.islower():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    codes = np.frombuffer(_OTHER.sub(" ", plain).encode("latin-1", "replace"), dtype=np.uint8).astype(np.uint32)
    h, parts = codes, [codes * _SPREAD]
    for n in (1, 2, 3):
        if len(codes) > n:
            h = h[:-1] * np.uint32(257) + codes[n:]
            parts.append((h + np.uint32(n << 24)) * _SPREAD)
    return (np.concatenate(parts) >> np.uint32(32 - BITS)).astype(np.int64)


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, count) of the letter n-grams of a text."""
    return np.unique(grams(text), return_counts=True)


class Centroids:
    """A fitted classifier: IDF weights and several unit centroids per language."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, languages: list[str]) -> None:
        self.idf = idf.astype(np.float32)
        self.weighted = np.ascontiguousarray((centres * idf).T.astype(np.float32))  # [dimension, centroid]
        self.of = [np.array([i for i, x in enumerate(languages) if x == code]) for code in LANGUAGES]
        self.known = [i for i, own in enumerate(self.of) if len(own)]

    def classify(self, words: str) -> tuple[str | None, float]:
        """(language, confidence), or (None, confidence of the nearest) if none is near enough."""
        h = grams(words)
        where, count = np.unique(h, return_counts=True)
        x = count * self.idf[where]
        norm = float(np.sqrt(x @ x))
        if not norm or not self.known:
            return None, 0.0
        cosines = (count.astype(np.float32) @ self.weighted[where]) / norm
        by_language = sorted(((float(cosines[self.of[i]].max()), LANGUAGES[i]) for i in self.known), reverse=True)
        best, second = by_language[0], by_language[1][0] if len(by_language) > 1 else 0.0
        confidence = best[0] / (best[0] + max(second, 0.0)) if best[0] > 0 else 0.0
        return (best[1] if best[0] >= NEAREST and best[0] - second >= MARGIN else None), round(confidence, 4)


def _dense(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, t in enumerate(texts):
        where, count = vector(t)
        out[i, where] = count * idf[where]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-9)


def _spread(rows: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """Rows that lie far from each other, the heavy ones first: seeds of clusters."""
    nearest, picked = np.zeros(len(rows), dtype=np.float32), []
    for _ in range(most):
        i = int((score := weight * (1 - nearest)).argmax())
        if score[i] <= 1e-6:
            break
        picked.append(i)
        nearest = np.maximum(nearest, rows @ rows[i])
    return rows[picked]


def _settle(rows: np.ndarray, weight: np.ndarray, middle: np.ndarray, rounds: int) -> np.ndarray:
    """Weighted k-means by cosine from the given centres; a centre nothing is near stays where it is."""
    for _ in range(rounds):
        near = (rows @ middle.T).argmax(axis=1)
        middle = _unit(np.stack([weight[own] @ rows[own] if (own := near == i).any() else middle[i] for i in range(len(middle))]))
    return middle


def _clean(data: dict[str, np.ndarray], weight: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Without the sentences that are clearly nearer to another label's mean than to their own."""
    for _ in range(4):
        means = {k: _unit(weight[k] @ v) for k, v in data.items() if len(v)}
        others = {k: np.stack([m for j, m in means.items() if j != k]) for k in means} if len(means) > 1 else {}
        stays = {k: data[k] @ means[k] + SLACK >= (data[k] @ others[k].T).max(axis=1) for k in others}
        data, weight = {k: v[stays[k]] if k in stays else v for k, v in data.items()}, {k: w[stays[k]] if k in stays else w for k, w in weight.items()}
    return {k: v for k, v in data.items() if len(v)}, weight


def fit(samples: dict[str, Counter]) -> Centroids:
    """Fits the classifier on the contents of sentences by label, counted by documents; wrong labels are dropped on the way.

    A sentence belongs to the label under which it is CLEAR times as common as under any other; without such a label it is
    left out.  Seeds lie far apart, common sentences first.  Then the fit is checked on its own sentences: where one is not
    nearer to its own language than to any other by LEAD, its language gets further centroids, until none is or no more help.
    """
    counts = {k: c for k, c in sorted(samples.items()) if c}
    share = {k: 1 / c.total() for k, c in counts.items()}
    texts = {k: sorted(t for t in c if all(j == k or c[t] * share[k] >= CLEAR * o[t] * share[j] for j, o in counts.items())) for k, c in counts.items()}
    texts = {k: v for k, v in texts.items() if v}
    if not texts:
        return Centroids(np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), [])
    frequency = np.zeros(DIMENSIONS)
    for own in texts.values():
        for t in own:
            frequency[vector(t)[0]] += 1
    idf = np.log((1 + sum(map(len, texts.values()))) / (1 + frequency)) + 0.1
    data, weight = _clean({k: _dense(v, idf) for k, v in texts.items()}, {k: np.log1p(np.array([counts[k][t] for t in v], dtype=np.float32)) for k, v in texts.items()})
    centres = {k: _settle(v, weight[k], _spread(v, weight[k], CENTROIDS), 8) for k, v in data.items()}
    misread = None
    while len(centres) > 1:
        near = {k: {j: (v @ m.T).max(axis=1) for j, m in centres.items()} for k, v in data.items()}
        short = {k: np.flatnonzero(near[k][k] - np.max([near[k][j] for j in centres if j != k], axis=0) < LEAD) for k in centres}
        left = sum(map(len, short.values()))
        if not left or (misread is not None and left >= misread):
            break
        misread = left
        for k, s in short.items():
            if more := min(8, MOST_CENTROIDS - len(centres[k]), len(s)):
                centres[k] = _settle(data[k], weight[k], np.concatenate([centres[k], _spread(data[k][s], weight[k][s], more)]), 3)
    return Centroids(idf, np.concatenate(list(centres.values())), [k for k, m in centres.items() for _ in range(len(m))])


@F.arrow_udf(T.ArrayType(T.StringType()))
def _contents(texts: pa.Array) -> pa.Array:
    """The different contents of the sentences of a text that are long enough to tell a language."""
    found = [sorted({w for a, b in sentences(t) if (w := content(t[a:b])).count(" ") >= WHOLE_WORDS and "|" not in w}) for t in texts.to_pylist()]
    return pa.array(found, pa.list_(pa.string()))


def sample_sentences(documents: DataFrame, n_documents: int = SAMPLE_DOCUMENTS, n_sentences: int = SAMPLE_SENTENCES, salt: int = 0) -> dict[str, Counter]:
    """How many documents of a bounded sample have each sentence, by the language their label names.

    About ``n_documents`` documents per language whose label names just that language; which ones follows from hashes of
    their ids and the salt.  They are read whole.  Of their different sentences the ``n_sentences`` in most documents are
    kept per language, of equally common ones those with the smaller hash.
    """
    named = documents.where("text IS NOT NULL").select("doc_id", "text", label_languages(F.col("lang")).alias("_named")).where("size(_named) = 1")
    named = named.select(F.col("_named")[0].alias("code"), "text", F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)).alias("h"))
    counts = {r.code: r.n for r in named.groupBy("code").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return {}
    limit = F.try_element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, n_documents / n) * (1 << 20)))]), F.col("code"))
    common = named.where(F.col("h") < limit).select("code", F.explode(_contents("text")).alias("words")).groupBy("code", "words").agg(F.count("*").alias("n"))
    order = Window.partitionBy("code").orderBy(F.desc("n"), F.xxhash64("words", F.lit(salt)))
    samples: dict[str, Counter] = {}
    for r in common.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n_sentences).collect():
        samples.setdefault(r.code, Counter())[r.words] = r.n
    return samples


def fit_on(documents: DataFrame) -> Centroids:
    """The classifier fitted on a bounded sample of the labelled documents."""
    require(documents, "doc_id", "text", "lang")
    return fit(sample_sentences(documents))


def _beside_tables(text: str, a: int, b: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is a table) of the parts of a piece: rows of a table (lines with a '|') and what is between."""
    begin, of_table, at = a, None, a
    for line in text[a:b].splitlines(keepends=True):
        row = "|" in line
        if of_table is not None and row != of_table and (row or line.strip()):
            yield begin, at, of_table
            begin, of_table = at, row
        elif of_table is None and line.strip():
            of_table = row
        at += len(line)
    yield begin, b, bool(of_table)


def classified(text: str, classify) -> Iterator[tuple[int, int, str | None, float, bool]]:
    """(start, end, language, confidence, whole sentence) of the sentences of a text; rows of tables are in no language."""
    table = "|" in text
    for a, b in sentences(text):
        for c, d, row in _beside_tables(text, a, b) if table and "|" in text[a:b] else ((a, b, False),):
            piece = text[c:d]
            words = "" if row else content(piece)
            if words.count(" ") + 1 >= WHOLE_WORDS:
                language, sure = classify(words)
                yield c, d, language, sure, language is not None and piece.rstrip(_CLOSING)[-1:] in ".!?…"
            else:
                yield c, d, None, 0.0, False


def read_stretches(text: str, classify) -> list[tuple[int, int, str | None, float, int]]:
    """(start, end, language, confidence, whole sentences) of stretches of one language; what is in none joins what is
    before it, or at the start what follows.
    """
    out: list[list] = []  # start, end, language, confidence times length, length in the language, whole sentences
    for a, b, language, sure, whole in classified(text, classify):
        if out and (language is None or out[-1][2] in (None, language)):
            last = out[-1]
            last[1], last[2] = b, last[2] or language
        else:
            last = [a, b, language, 0.0, 0, 0]
            out.append(last)
        if language is not None:
            last[3] += sure * (b - a)
            last[4] += b - a
            last[5] += whole
    return [(a, b, language, round(total / size, 4) if size else 0.0, whole) for a, b, language, total, size, whole in out]


_STRETCH = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("n_sentences", T.IntegerType())]))
_STRETCH_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32())]))
_NAMES = ("start", "end", "lang", "confidence", "n_sentences")


def _reader(model: Centroids):
    made: list = []

    @F.arrow_udf(_STRETCH)
    def read(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(lru_cache(maxsize=300_000)(model.classify))
        return pa.array([None if t is None else [dict(zip(_NAMES, s)) for s in read_stretches(t, made[0])] for t in texts.to_pylist()], _STRETCH_ARROW)

    return read


def language_stretches(documents: DataFrame, model: Centroids) -> DataFrame:
    """Stretches of one language: doc_id, stretch_no, start, end, lang (null: none), confidence, n_sentences (whole ones).

    Null and empty texts have no stretches.  Positions are characters of the text; stretches cover it from its first to its
    last sentence, in order.
    """
    require(documents, "doc_id", "text")
    read = documents.select("doc_id", _reader(model)("text").alias("_s"))
    return read.select("doc_id", F.posexplode("_s").alias("_no", "_x")).select("doc_id", (F.col("_no") + 1).alias("stretch_no"), "_x.*")


def document_languages(documents: DataFrame, model: Centroids) -> DataFrame:
    """The languages of each document: doc_id, lang, share (of its text), confidence, n_sentences."""
    s = language_stretches(documents, model).where("lang IS NOT NULL")
    size = F.col("end") - F.col("start")
    sums = s.groupBy("doc_id", "lang").agg(F.sum(size).alias("_n"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"), F.sum("n_sentences").alias("n_sentences"))
    total = sums.groupBy("doc_id").agg(F.sum("_n").alias("_t"))
    return sums.join(total, "doc_id").select("doc_id", "lang", F.round(F.col("_n") / F.col("_t"), 4).alias("share"), F.round("confidence", 4).alias("confidence"), "n_sentences")


def unlabelled_languages(documents: DataFrame, model: Centroids) -> DataFrame:
    """Languages in which a text has a whole sentence and which its label does not name: doc_id, lang."""
    require(documents, "doc_id", "text", "lang")
    read = documents.select("doc_id", label_languages(F.col("lang")).alias("_named"), _reader(model)("text").alias("_s"))
    found = F.array_distinct(F.transform(F.filter("_s", lambda s: s["n_sentences"] > 0), lambda s: s["lang"]))
    return read.select("doc_id", F.explode(F.array_except(found, "_named")).alias("lang")).distinct()
