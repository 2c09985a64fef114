"""Reading folders of files into elements."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import require
from ledgerloom.sources.elements import ELEMENT, ELEMENT_ARROW, Malformed, Parsed
from ledgerloom.sources.kinds import content_fits, kind_of
from ledgerloom.sources.mail import attachments_of, parse_mail
from ledgerloom.sources.office import parse_docx, parse_pptx, parse_xlsx
from ledgerloom.sources.tables import parse_delimited
from ledgerloom.sources.texts import parse_html, parse_text


def _no_pdf(content: bytes) -> Parsed:
    raise Malformed("needs-ocr: no PDF library is available; register a parser for the kind pdf")


#: Parsers by kind.  Register others by adding to a copy.
PARSERS: dict[str, Callable[[bytes], Parsed]] = {
    "csv": parse_delimited, "tsv": lambda c: parse_delimited(c, "\t"), "txt": parse_text, "md": parse_text, "html": parse_html, "eml": parse_mail, "docx": parse_docx, "xlsx": parse_xlsx, "pptx": parse_pptx, "pdf": _no_pdf,
}


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder and those below it: relative_path, size_bytes, modified, content, sha256, kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/") + "/"), "^file:/*", "/")
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    return files.select(F.replace(path, root, F.lit("")).alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("sha256"), kind_of(F.lit(None).cast("string"), F.col("path")).alias("kind"))


def _parse(parsers: dict[str, Callable[[bytes], Parsed]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, kind, fits, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                try:
                    if kind not in parsers:
                        raise Malformed(f"no parser for kind {kind}")
                    if not fits:
                        raise Malformed("the content is not of the declared kind")
                    for i, e in enumerate(parsers[kind](content or b"").elements):
                        rows.append({"file_id": file_id, "ordinal": i, "text": e.text, "kind": e.kind, "heading_path": list(e.heading_path), "block_index": e.block_index, "paragraph_index": e.paragraph_index, "slide": e.slide, "sheet_name": e.sheet_name, "cell": e.cell, "merge_covered": e.merge_covered, "error": None})
                except Malformed as e:
                    rows.append({"file_id": file_id, "ordinal": -1, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=ELEMENT_ARROW)

    return run


def parse_files(files: DataFrame, parsers: dict[str, Callable[[bytes], Parsed]] = PARSERS) -> DataFrame:
    """Elements of files: file_id, ordinal, text, place, error.  ``files``: file_id, kind, content.

    A file that cannot be read gives one row with ordinal -1 and the error; others are not affected.
    """
    require(files, "file_id", "kind", "content")
    ready = files.select(F.col("file_id").cast("string"), "kind", content_fits(F.col("content"), F.col("kind")).alias("fits"), "content")
    return ready.mapInArrow(_parse(parsers), ELEMENT)


def unwrap_attachments(files: DataFrame) -> DataFrame:
    """Attachments of messages as files: parent_id, part_index, name, kind, content.  Messages that cannot be read have none."""
    schema = "parent_id string, part_index int, name string, mime string, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parent, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"parent_id": parent, "part_index": a.part_index, "name": a.name, "mime": a.mime, "content": a.content} for a in attachments_of(content or b"")]
                except Malformed:
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("parent_id", pa.string()), ("part_index", pa.int32()), ("name", pa.string()), ("mime", pa.string()), ("content", pa.binary())]))

    found = files.where("kind = 'eml'").select(F.col("file_id").cast("string"), "content").mapInArrow(run, schema)
    return found.select("parent_id", "part_index", "name", kind_of(F.col("mime"), F.col("name")).alias("kind"), "content")
