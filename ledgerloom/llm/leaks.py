"""Finding evaluation passages inside a large corpus.

Candidates come from windows of words.  Each window is embedded by a CGK random walk: a pointer moves over the letters,
and at each step the letter under it is put out and a random function of step and letter decides whether it moves on.  Two
windows within a small edit distance fall back into step after each edit, so that edit distance becomes Hamming distance,
and bit-sampling LSH finds them: several tables, each hashing the walk's output at a random choice of steps.  The windows of
the evaluation items (a stated query set, in blocks) start at every word; those of the documents at every STRIDE-th, close
enough that any run of the wanted length holds some.  Every candidate is then aligned with the item's words, outwards from the
window, with at most one misread character in a word; and the run that comes out is verified by its exact edit distance: the
letters of both sides may differ by at most one in LETTERS_PER_EDIT (a banded computation, exact within the band).

The corpus is read once and never shuffled: only findings leave the tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.catalog import require

LEAST_WORDS = 15
STRIDE = 5  # words between window starts in documents; 15 words of four letters hold at least one whole window
STEPS = 60  # of the walk; the pointer moves every other step on average, so a window reaches over 30 letters
TABLES, SAMPLED = 6, 9  # recall of a window with one misread letter: about 1 - (1 - 0.4)^6 = 0.95, more with several windows
LETTERS_PER_EDIT = 8  # a run of passages is no copy if more than one letter in so many is misread
BLOCK = 5000  # items per pass over the documents
CHUNK = 4_000_000  # letters that are embedded at once

_TAG = re.compile(r"<[^<>\n]{1,80}>")
_BROKEN = re.compile(r"[-‐‑­]\s*\n\s*")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_DELETE = bytes(c for c in range(33, 128) if not chr(c).isalnum())
_CONFUSED = bytes.maketrans(b"oqlizsgb", b"00112598")  # letters that digits are misread as


def _bare(text: str) -> str:
    """Without tags, line-end hyphens and characters nobody sees; letters and their accents apart."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "\n" in text and ("-\n" in text or _BROKEN.search(text)):
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
    return text


def plain_words(text: str) -> list[bytes]:
    """Words without case, accents, punctuation, tags and line-end hyphens; words without letters or digits vanish."""
    return _bare(text).encode("ascii", "ignore").translate(_LOWER, _DELETE).split()


def marks_between(text: str) -> list[int]:
    """How many words without letters or digits (a lone & or dash) stand before each plain word, and after the last."""
    found = [0]
    for w in _bare(text).split():
        n = len(w.encode("ascii", "ignore").translate(_LOWER, _DELETE).split())
        if n:
            found += [0] * n
        else:
            found[-1] += 1
    return found


def _walks() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(15)
    moves = rng.integers(0, 2, (STEPS, 256), dtype=np.uint8)
    tables = np.stack([np.sort(rng.choice(STEPS, SAMPLED, replace=False)) for _ in range(TABLES)])
    return moves, tables


MOVES, SAMPLES = _walks()
_BY_STEP = [[k for k in range(TABLES) if t in SAMPLES[k]] for t in range(STEPS)]
_MULTIPLIER = np.uint32(0x9E3779B1)
_AT_ONCE = 16_384  # windows walked together: their state stays in the processor's cache


def embed(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[table, window]: hashes of the sampled steps of the CGK walk of each window.

    ``letters`` must be padded by STEPS zeros.
    """
    hashes = np.zeros((TABLES, len(starts)), dtype=np.uint32)
    for begin in range(0, len(starts), _AT_ONCE):
        at = starts[begin : begin + _AT_ONCE].astype(np.int32)
        rows = [np.zeros(len(at), dtype=np.uint32) for _ in range(TABLES)]
        for t in range(STEPS):
            out = letters.take(at)
            for k in _BY_STEP[t]:
                h = rows[k]
                h ^= out
                h *= _MULTIPLIER
                h ^= h >> np.uint32(15)
            at += MOVES[t].take(out)
        for k in range(TABLES):
            hashes[k, begin : begin + len(at)] = rows[k]
    return hashes


def _stream(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the words run together, padded, and where each word starts."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    return np.frombuffer(b"".join(words) + bytes(STEPS), dtype=np.uint8), starts


class Passages:
    """An index of evaluation items."""

    MASK = (1 << 22) - 1

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.words: list[list[bytes]] = []
        self.counted: list[list[int]] = []  # words of the item, as white space separates them, before each plain word
        self.length: list[int] = []  # words of the item, as white space separates them
        owners, places, hashes = [], [], []
        for n, (_, text) in enumerate(items):
            words, counted = [], []
            for i, raw in enumerate(text.split()):
                for w in plain_words(raw):
                    words.append(w)
                    counted.append(i)
            self.words.append(words)
            self.counted.append(counted)
            self.length.append(len(text.split()))
            if words:
                letters, starts = _stream(words)
                hashes.append(embed(letters, starts))
                owners.append(np.full(len(words), n))
                places.append(np.arange(len(words)))
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.place = np.concatenate(places) if places else np.zeros(0, np.int64)
        every = np.concatenate(hashes, axis=1) if hashes else np.zeros((TABLES, 0), np.uint32)
        self.order = np.argsort(every, axis=1, kind="stable")
        self.sorted = np.take_along_axis(every, self.order, axis=1)
        self.maybe = np.zeros((TABLES, self.MASK + 1), dtype=bool)
        for k in range(TABLES):
            self.maybe[k, (every[k] & np.uint32(self.MASK)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, word of the item) of windows that share a bucket, in the order of the windows.

        None is dropped here: whether the words around agree is for shared_run to say, which allows letters to be lost or
        added.  It ends at the first word that differs, so that a chance match costs one comparison of words.
        """
        pairs = []
        for k in range(TABLES):
            w = np.flatnonzero(self.maybe[k].take(hashes[k] & np.uint32(self.MASK)))
            a, b = np.searchsorted(self.sorted[k], hashes[k][w], "left"), np.searchsorted(self.sorted[k], hashes[k][w], "right")
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append(np.repeat(w, n) * len(self.owner) + self.order[k][at])
        pairs = np.unique(np.concatenate(pairs))
        for begin in range(0, len(pairs), _AT_ONCE):
            w, at = np.divmod(pairs[begin : begin + _AT_ONCE], len(self.owner))
            yield from zip(w.tolist(), self.owner[at].tolist(), self.place[at].tolist())


def agrees(item: bytes, seen: bytes) -> bool:
    """Whether ``seen`` is the item's word with at most one misread character.

    A number must be the same one, if letters are read as the digits they resemble.  Words of letters may have one letter
    replaced, if they have four or more, or two run into one (rn as m), if they have five or more.
    """
    if item == seen:
        return True
    if any(48 <= c <= 57 for c in item):
        return len(item) == len(seen) and not item.isalpha() and item.translate(_CONFUSED) == seen.translate(_CONFUSED)
    n = len(item)
    if len(seen) == n and n >= 4:
        return sum(a != b for a, b in zip(item, seen)) == 1
    if abs(len(seen) - n) == 1 and n >= 5:
        short, long = (item, seen) if n < len(seen) else (seen, item)
        i = next((i for i in range(len(short)) if short[i] != long[i]), len(short))
        return short[i:] == long[i + 1 :] or (i + 1 <= len(short) and short[i + 1 :] == long[i + 2 :])
    return False


def _reach(item: list[bytes], seen: list[bytes], i: int, j: int, step: int) -> tuple[int, int]:
    """How far the alignment goes from item word i and seen word j (both taken as included) in one direction."""
    last = (i - step, j - step)
    while 0 <= i < len(item) and 0 <= j < len(seen):
        if agrees(item[i], seen[j]):
            last = (i, j)
            i, j = i + step, j + step
            continue
        two = 0 <= j + step < len(seen) and (seen[j] + seen[j + step] if step > 0 else seen[j + step] + seen[j])
        if two and agrees(item[i], two):
            last = (i, j + step)
            i, j = i + step, j + 2 * step
            continue
        pair = 0 <= i + step < len(item) and (item[i] + item[i + step] if step > 0 else item[i + step] + item[i])
        if pair and agrees(pair, seen[j]):
            last = (i + step, j)
            i, j = i + 2 * step, j + step
            continue
        # A misread short word counts if the two words after it are as they should be.
        short = len(item[i]) == len(seen[j]) < 4 and item[i].isalpha() and sum(a != b for a, b in zip(item[i], seen[j])) == 1
        a, b = i + 2 * step, j + 2 * step
        if short and 0 <= a < len(item) and 0 <= b < len(seen) and item[i + step] == seen[j + step] and item[a] == seen[b]:
            last = (i, j)
            i, j = i + step, j + step
            continue
        break
    return last


def edits_within(a: bytes, b: bytes, most: int) -> int:
    """The edit distance of two strings, or most + 1 if it is larger: Ukkonen's band of diagonals, the furthest reach on each.

    The work grows with the length and the square of the distance, not with the product of the lengths.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    reach: dict[int, int] = {}
    for e in range(most + 1):
        now: dict[int, int] = {}
        for d in range(-e, e + 1):
            x = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1) if e else 0
            if x < 0 or x > len(a) or x + d < 0:
                continue
            x = min(x, len(b) - d)
            while x < len(a) and x + d < len(b) and a[x] == b[x + d]:
                x += 1
            if x == len(a) and x + d == len(b):
                return e
            now[d] = x
        reach = now
    return most + 1


def shared_run(passages: Passages, n: int, seen: list[bytes], i: int, j: int, least: int = 1, marks=None) -> tuple[int, int, int, int]:
    """(words of item n covered, first and last seen word, edits) of the alignment through item word i and seen word j.

    Words without letters count between the ends of the run.  Beside its ends they count as far as ``marks`` (how many such
    words stand before each seen word) has them too; it is a function, called only if they decide about ``least``.  A run
    whose letters differ too much covers nothing.
    """
    item = passages.words[n]
    right = _reach(item, seen, i, j, 1)
    if right[0] < i:
        return 0, j, j, 0
    left = _reach(item, seen, i - 1, j - 1, -1)
    first = left if left[0] < i else (i, j)
    counted = passages.counted[n]
    covered = counted[right[0]] - counted[first[0]] + 1
    if covered < least and marks:
        before = counted[first[0]] - (counted[first[0] - 1] + 1 if first[0] else 0)
        after = (counted[right[0] + 1] if right[0] + 1 < len(counted) else passages.length[n]) - counted[right[0]] - 1
        if covered + before + after >= least:
            there = marks()
            covered += min(before, there[first[1]]) + min(after, there[right[1] + 1])
    if covered < least:
        return covered, first[1], right[1], 0
    a, b = b"".join(item[first[0] : right[0] + 1]), b"".join(seen[first[1] : right[1] + 1])
    most = len(a) // LETTERS_PER_EDIT
    edits = edits_within(a, b, most)
    return (covered if edits <= most else 0), first[1], right[1], edits


def find_in(texts: list[tuple[int, str | None]], passages: Passages, least: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(doc, item, words, first word, last word, edits): the longest run of each item in each document, if it is long enough."""
    words = [plain_words(t) if t else [] for _, t in texts]
    begin = 0
    while begin < len(texts):
        end, letters = begin, 0
        while end < len(texts) and (end == begin or letters < CHUNK):
            letters += sum(map(len, words[end]))
            end += 1
        flat = [w for ws in words[begin:end] for w in ws]
        counts = np.fromiter(map(len, words[begin:end]), np.int64, end - begin)
        offsets = np.cumsum(counts) - counts
        if flat:
            stream, starts = _stream(flat)
            number = np.arange(len(flat)) - np.repeat(offsets, counts)
            windows = np.flatnonzero(number % STRIDE == 0)
            best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
            marks: dict[int, list[int]] = {}
            for w, n, i in passages.candidates(embed(stream, starts[windows])):
                d = int(np.searchsorted(offsets, windows[w], "right")) - 1
                while counts[d] == 0:
                    d -= 1
                j = int(windows[w] - offsets[d])
                known = best.get((d, n))
                if known and known[0] >= least and known[1] <= j <= known[2]:
                    continue
                # The marks of a document are looked for at most once, and only where a run lacks a word or two.
                between = lambda d=d: marks.setdefault(d, marks_between(texts[begin + d][1]) if d not in marks else [])
                run = shared_run(passages, n, words[begin + d], i, j, least, between)
                if run[0] >= least and (not known or run[0] > known[0]):
                    best[(d, n)] = run
            for (d, n), run in sorted(best.items()):
                yield texts[begin + d][0], passages.ids[n], *run
        begin = end


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()), T.StructField("n_edits", T.IntegerType())])


def _finder(items: list[tuple[int, str]], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(items)
        for batch in batches:
            rows = list(find_in(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), passages, least))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))], names=[f.name for f in _FOUND])

    return run


def find_leaks(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Documents that repeat ``least`` or more consecutive words of an item: doc_id, item_id, n_words, first_word, last_word, n_edits.

    n_words counts the item's words as white space separates them; first_word and last_word are positions among the
    document's words that have letters or digits; n_edits is the edit distance of the letters on both sides.  One row per document and item, for the longest run.  Null and empty
    texts leak nothing; documents or items stored several times count once.  Items travel to the tasks in blocks of BLOCK.
    """
    require(documents, "doc_id", "text")
    require(items, "item_id", "text")
    listed = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text"))
    blocks: list[list[tuple[int, str]]] = [[]]
    for r in listed.orderBy("item_id").toLocalIterator():
        if len(blocks[-1]) == BLOCK:
            blocks.append([])
        blocks[-1].append((r.item_id, r.text))
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    found = None
    for block in blocks:
        part = texts.mapInArrow(_finder(block, least), _FOUND)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "first_word", "last_word", "n_edits")).alias("r")).select("doc_id", "item_id", "r.*")
