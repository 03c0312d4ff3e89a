"""Label files and attachments: discovery, validity, decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "txt", "docx", "doc", "md")
RECORD = "name string, id string, content string, data string, path string, url string, size bigint, type string, mime_type string"
#: Places of a request that may hold attachments, in order.
PLACES = ("$.files", "$.body.files", "$.attachments", "$.documents")


def scan_files(spark: SparkSession, folder: str, extensions: str | Sequence[str] = "pdf", content: bool = False) -> DataFrame:
    """path, file_name, modified, size_mb (and content) of the files under a folder, by any scheme Spark reads."""
    kinds = [extensions] if isinstance(extensions, str) else list(extensions)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("file_name"), F.col("modificationTime").alias("modified"), (F.col("length") / 1024 / 1024).alias("size_mb"), "content")
    return out if content else out.drop("content")


def attachments(requests: DataFrame, key: str, payload: Column) -> DataFrame:
    """key, ord, and the nine fields of each attachment of a request, from all places in order."""
    doc = F.try_parse_json(payload)
    none = F.array().cast(f"array<struct<{RECORD.replace(' ', ':').replace(',:', ',')}>>")
    kind = f"array<struct<{', '.join(x.strip().replace(' ', ': ') for x in RECORD.split(','))}>>"
    found = [F.coalesce(F.try_variant_get(doc, p, kind), none) for p in PLACES]
    single = F.try_variant_get(doc, "$.file", kind.removeprefix("array<").removesuffix(">"))
    found.append(F.when(single.isNotNull(), F.array(single)).otherwise(none))
    return requests.select(key, F.posexplode(F.concat(*found)).alias("ord", "file")).select(key, "ord", "file.*")


def is_valid(name: Column, path: Column, data: Column, content: Column, size: Column) -> Column:
    """A payload of some kind, and a known extension on the name or the path."""
    known = rf"(?i)\.({'|'.join(EXTENSIONS)})$"
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return (some(path) | some(data) | some(content) | (F.coalesce(size, F.lit(0)) > 0)) & (F.coalesce(name.rlike(known), F.lit(False)) | F.coalesce(path.rlike(known), F.lit(False)))


def normalised_file(files: DataFrame) -> DataFrame:
    """All nine fields, with defaults."""
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d)).alias(c)
    return files.select(text("name", "unknown"), text("id"), text("content"), text("data"), text("path"), text("url"), F.coalesce("size", F.lit(0)).alias("size"), text("type"), text("mime_type"))


def inline_bytes(data: Column) -> Column:
    """Bytes of a base64 payload, with or without a ``data:…,`` prefix; null where it isn't base64."""
    return F.try_to_binary(F.regexp_replace(data, r"^data:[^,]*,", ""), F.lit("base64"))


def decoded(content: Column, raw: Column) -> Column:
    """Inline content first, else the bytes as UTF-8, else as Latin-1 (which always succeeds)."""
    return F.coalesce(F.nullif(content, F.lit("")), F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1")))


def with_extension(files: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    return files.filter(F.col("file_name").rlike(rf"(?i)\.({'|'.join(extensions)})$"))
