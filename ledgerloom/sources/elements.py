"""Elements that parsers give: texts with their place in the document."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import types as T


@dataclass
class Element:
    """A text and where it stands."""

    text: str
    kind: str
    heading_path: tuple[str, ...] = ()
    block_index: int | None = None
    paragraph_index: int | None = None
    slide: int | None = None
    sheet_name: str | None = None
    cell: str | None = None
    merge_covered: bool = False


@dataclass
class Parsed:
    """What a parser made of a file."""

    elements: list[Element]
    reasons: list[str] = field(default_factory=list)  # why fidelity is reduced


class Malformed(ValueError):
    """The file is not what it claims to be, or exceeds a limit."""


ELEMENT = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("heading_path", T.ArrayType(T.StringType())), T.StructField("block_index", T.IntegerType()), T.StructField("paragraph_index", T.IntegerType()), T.StructField("slide", T.IntegerType()),
    T.StructField("sheet_name", T.StringType()), T.StructField("cell", T.StringType()), T.StructField("merge_covered", T.BooleanType()), T.StructField("error", T.StringType()),
])
ELEMENT_ARROW = pa.schema([
    ("file_id", pa.string()), ("ordinal", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("heading_path", pa.list_(pa.string())), ("block_index", pa.int32()), ("paragraph_index", pa.int32()),
    ("slide", pa.int32()), ("sheet_name", pa.string()), ("cell", pa.string()), ("merge_covered", pa.bool_()), ("error", pa.string()),
])


def column_letters(index: int) -> str:
    """Letters of a spreadsheet column (0 is A)."""
    letters, n = "", index + 1
    while n:
        n, rest = divmod(n - 1, 26)
        letters = chr(65 + rest) + letters
    return letters
