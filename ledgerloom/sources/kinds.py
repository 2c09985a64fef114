"""What kind of document a file is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# MIME types of the kinds, and extensions that decide where the type is ambiguous.
KIND_OF_MIME = {
    "application/pdf": "pdf", "text/csv": "csv", "text/tab-separated-values": "tsv", "text/plain": "txt", "text/markdown": "md", "text/html": "html", "message/rfc822": "eml",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
}
AMBIGUOUS_MIME = ("application/octet-stream", "application/vnd.ms-excel", "text/plain", "application/zip")
KIND_OF_EXTENSION = {"pdf": "pdf", "csv": "csv", "tsv": "tsv", "txt": "txt", "md": "md", "markdown": "md", "html": "html", "htm": "html", "eml": "eml", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx"}
ZIPPED = ("docx", "xlsx", "pptx")


def kind_of(mime: Column, name: Column) -> Column:
    """The kind by extension where the MIME type is ambiguous (and the extension known), else by type; null if neither tells."""
    by_mime = F.create_map(*[F.lit(v) for kv in KIND_OF_MIME.items() for v in kv])
    by_ext = F.create_map(*[F.lit(v) for kv in KIND_OF_EXTENSION.items() for v in kv])
    plain = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("application/octet-stream")), ";", 1)))
    ext = F.try_element_at(by_ext, F.lower(F.substring_index(F.coalesce(name, F.lit("")), ".", -1)))
    return F.when(plain.isin(*AMBIGUOUS_MIME), F.coalesce(ext, F.try_element_at(by_mime, plain))).otherwise(F.try_element_at(by_mime, plain))


def content_fits(content: Column, kind: Column) -> Column:
    """Whether the first bytes are what the kind must, or must not, begin with."""
    pdf = F.hex(F.substring(content, 1, 5)) == "255044462D"
    zipped = F.hex(F.substring(content, 1, 4)).isin("504B0304", "504B0506", "504B0708")
    return F.coalesce(F.when(kind == "pdf", pdf).when(kind.isin(*ZIPPED), zipped).otherwise(~pdf & ~zipped), F.lit(False))
