"""What a captured file is, and its text, natively from its first bytes and headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types of the kinds of files that are read.
MEDIA = {
    "application/pdf": "pdf", "text/csv": "csv", "application/csv": "csv", "application/json": "json", "text/json": "json",
    "text/plain": "text", "text/markdown": "text", "application/vnd.ms-excel": "xls", "application/zip": "zip",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "text/html": "page", "application/xhtml+xml": "page",
}
EXTENSIONS = {"pdf": "pdf", "csv": "csv", "json": "json", "txt": "text", "md": "text", "xls": "xls", "xlsx": "xlsx", "zip": "zip", "html": "page", "htm": "page"}


def media_type(content_type: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))), F.lit(""))


def content_class(content_type: Column) -> Column:
    """Kind by the media type; ``unsupported`` for others, null for none."""
    m = media_type(content_type)
    known = F.element_at(F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv)), m)
    return F.when(m.isNull(), F.lit(None)).otherwise(F.coalesce(known, F.lit("unsupported")))


def has_pdf_header(content: Column, window: int = 1024) -> Column:
    return F.contains(F.substring(content, 1, window).cast("binary"), F.lit(b"%PDF-"))


def is_gzip(url: Column, content: Column) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 2)) == "1F8B", F.lit(False)) | F.coalesce(
        F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".gz"), F.lit(False)
    )


def detect(content_type: Column, content: Column, name: Column) -> Column:
    """Kind of a file: magic bytes first, then a media type that says more than that bytes
    follow, then the extension, else ``page`` if it looks like markup, else ``unsupported``."""
    magic = F.hex(F.substring(content, 1, 8))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    by_ext = F.element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ext)
    by_type = F.when(~media_type(content_type).isin("application/octet-stream", "binary/octet-stream"), content_class(content_type))
    by_type = F.when(by_type != "unsupported", by_type)
    head = F.lower(F.substring(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), 1, 512))
    return (
        F.when(has_pdf_header(content), "pdf")
        .when(magic.startswith("504B0304"), F.when((by_type == "xlsx") | (ext == "xlsx"), "xlsx").otherwise("zip"))
        .when(magic.startswith("D0CF11E0"), "xls")
        .otherwise(F.coalesce(by_type, by_ext, F.when(head.rlike(r"^\s*<(?:!doctype html|html|head|body)\b"), "page"), F.lit("unsupported")))
    )


def decode_text(content: Column, content_type: Column) -> Column:
    """``struct(text, encoding)``: by byte order mark, then charset, then UTF-8, strictly;
    null text where the bytes are not valid in it."""
    bom = F.hex(F.substring(content, 1, 3))
    charset = F.lower(F.regexp_extract(content_type, r"(?i)charset\s*=\s*\"?([\w-]+)", 1))
    encoding = (
        F.when(bom == "EFBBBF", "utf-8")
        .when(bom.startswith("FFFE"), "utf-16le")
        .when(bom.startswith("FEFF"), "utf-16be")
        .when(charset.isin("iso-8859-1", "latin1", "windows-1252"), "iso-8859-1")
        .when(charset.isin("utf-16", "utf-16le", "utf-16be"), charset)
        .otherwise("utf-8")
    )
    utf8 = F.try_validate_utf8(content.cast("string"))
    text = (
        F.when(encoding == "utf-8", utf8)
        .when(encoding == "iso-8859-1", F.decode(content, "ISO-8859-1"))
        .when(encoding == "utf-16le", F.decode(content, "UTF-16LE"))
        .when(encoding == "utf-16be", F.decode(content, "UTF-16BE"))
        .otherwise(F.decode(content, "UTF-16"))
    )
    return F.struct(F.regexp_replace(text, r"^\x{feff}", "").alias("text"), encoding.alias("encoding"))
