"""Document kinds: the registry as a table, lookups by extension and mime type, and sniffing of file contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import fixed

COLUMNS = ["kind", "label", "mime_type", "other_mime_types", "extensions", "extractable", "exportable", "quota", "quota_unit", "container"]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.FORMATS, COLUMNS)


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def extension_of(name: Column) -> Column:
    """The lower-cased extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)\z", 1))


def kind_for_extension(ext: Column) -> Column:
    return _lookup({e: f[0] for f in fixed.FORMATS for e in f[4].split()})[F.lower(ext)]


def kind_for_mime(mime: Column) -> Column:
    pairs = {m: f[0] for f in fixed.FORMATS for m in [f[2], *f[3].split()]}
    return _lookup(pairs)[F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))]


def quota_quantity(kind: Column, pages: Column, cells: Column, size: Column) -> Column:
    """What a document counts for: filled cells, KiB of text (at least 1), images (1) or pages (at least 1)."""
    return F.when(kind.isin("xlsx", "csv", "tsv"), cells).when(kind.isin("eml", "mbox"), F.greatest(F.ceil(size / 1024), F.lit(1))).when(kind == "image", F.lit(1)).otherwise(F.greatest(pages, F.lit(1))).cast("long")


# Leading bytes in hex.
MAGIC = [("25504446", "pdf"), ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("7B5C727466", "rtf")]
_ZIP, _PARTS = "504B0304", (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"))
_FROM = r"\AFrom (?:\S+ +)?(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) {1,2}[0-9]{1,2} [0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[^\n]*)?\r?\n[!-9;-~]+:"
_HEADER = r"(?i)\A(?:[!-9;-~]+:[^\n]*\r?\n(?:[ \t][^\n]*\r?\n)*)*?(?:from|to|subject|date|message-id|mime-version|received|return-path):"


def sniff(content: Column, name: Column | None = None) -> Column:
    """The kind of a file by its bytes, else (text in UTF-8 without control characters) by its name; null if unknown."""
    start = F.hex(F.substring(content, 1, 8))
    latin = F.decode(F.substring(content, 1, 16384), "ISO-8859-1")
    every = F.decode(content, "ISO-8859-1")
    out = None
    for magic, kind in MAGIC:
        out = F.when(start.startswith(magic), kind) if out is None else out.when(start.startswith(magic), kind)
    webp = start.startswith("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    out = out.when(webp, "image")
    for part, kind in _PARTS:
        out = out.when(start.startswith(_ZIP) & F.contains(every, F.lit(part)), kind)
    out = out.when(start.startswith(_ZIP), F.lit(None)).when(latin.rlike(_FROM), "mbox").when(latin.rlike(_HEADER), "eml")
    if name is not None:
        by_name = kind_for_extension(extension_of(name))
        out = out.when(by_name.isin("csv", "tsv", "txt") & is_text(content), by_name)
    return out


def is_text(content: Column) -> Column:
    """Valid UTF-8 without control characters other than tab and line breaks, in the first 64 KiB."""
    head = F.substring(content, 1, 65536)
    text = F.try_validate_utf8(F.regexp_replace(F.decode(head, "UTF-8"), "\\uFFFD\\z", ""))
    whole = F.call_function("is_valid_utf8", head.cast("string"))
    return (whole | (F.octet_length(content) > 65536)) & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
