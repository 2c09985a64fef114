"""Unicode forms, which Spark has no built-in for, as Arrow functions (no row-at-a-time Python)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normalized(texts: pa.Array, form: str) -> pa.Array:
    # unicodedata, not pyarrow.compute.utf8_normalize: pyarrow 23.0.1 leaves decomposed letters decomposed under NFC.
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return _normalized(texts, "NFC")


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return _normalized(texts, "NFKC")


@F.arrow_udf(T.StringType())
def _nfkd(texts: pa.Array) -> pa.Array:
    return _normalized(texts, "NFKD")


def _beyond_ascii(c: Column, form) -> Column:
    """Only texts beyond ASCII leave the JVM; the others are their own form under all normalisations."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, c).otherwise(form(F.when(~plain, c)))


def nfc(c: Column) -> Column:
    """Canonical composition; null stays null.  Every text leaves the JVM once: the column is not evaluated a second time, as
    the others are, which pays where it is itself costly.
    """
    return _nfc(c)


def nfkc(c: Column) -> Column:
    """Compatibility composition; null stays null."""
    return _beyond_ascii(c, _nfkc)


def nfkd(c: Column) -> Column:
    """Compatibility decomposition; null stays null."""
    return _beyond_ascii(c, _nfkd)


#: White space as ECMAScript's \s sees it, for Java regular expressions, in code point order.
JS_SPACE = r"[\t\n\x0b\f\r    -     　﻿]"


def collapse_space(c: Column) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(c, JS_SPACE + "+", " "))


def strip_accents(c: Column) -> Column:
    """Letters without their combining marks."""
    return F.regexp_replace(nfkd(c), r"\p{M}+", "")
