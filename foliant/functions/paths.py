"""Path, time and status functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind.
ARCHIVES = ["zip", "rar", "7z", "tar", "gz", "bz2"]
DOCUMENTS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "csv", "md"]
IMAGES = ["jpg", "jpeg", "png", "tif", "tiff", "bmp", "gif", "webp"]
EPOCH_TICKS = 116444736000000000  # of 1970 in 100 ns steps since 1601


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def normal_folder(path: Column) -> Column:
    return F.concat(F.rtrim(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit("/")), F.lit("/"))


def is_under_any(path: Column, folders: list[str]) -> Column:
    """Whether a path is one of the folders or inside one; siblings with the same beginning aren't."""
    return reduce(lambda a, b: a | b, [F.startswith(normal_folder(path), normal_folder(F.lit(f))) for f in folders], F.lit(False))


def to_native(path: Column, separator: str = "/") -> Column:
    return F.replace(F.replace(path, F.lit("\\"), F.lit(separator)), F.lit("/"), F.lit(separator))


def has_extension(extension: Column, among: list[str]) -> Column:
    return F.lower(extension).isin([e.lower() for e in among])


def filetime(ticks: Column) -> Column:
    """Timestamp of 100 ns ticks since 1601, to the millisecond."""
    return F.timestamp_millis(F.floor((ticks - F.lit(EPOCH_TICKS)) / 10000).cast("long"))


def priority(extension: Column, modified: Column, as_of: Column) -> Column:
    """1: within 30 days, 2: within 365, 3: older; 4: archives of any age."""
    age = F.datediff(as_of, modified)
    return F.when(has_extension(extension, ARCHIVES), 4).when(age <= 30, 1).when(age <= 365, 2).otherwise(3)


def top_two(path: Column) -> Column:
    """The first two folders of a path."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice(parts, 1, 2), "/"))


def status_label(status: Column) -> Column:
    #: Fixed values.
    names = {"pending": "Pending", "metadata_only": "Metadata only", "content_done": "Content indexed", "ocr_done": "OCR complete", "failed": "Failed", "not_needed": "Not needed", "done": "Done", "skipped": "Skipped", "running": "Running"}
    out = F.when(status == "pending", names["pending"])
    for k, v in list(names.items())[1:]:
        out = out.when(status == k, v)
    return out.when(status == "", "-").otherwise(status)


def cache_key(path: Column, modified: Column, size: Column) -> Column:
    return F.md5(F.concat_ws("|", path, modified.cast("string"), size.cast("string")))


def needs_ocr(flag: Column, text: Column, extension: Column) -> Column:
    return flag | ((F.trim(F.coalesce(text, F.lit(""))) == "") & has_extension(extension, IMAGES))


def initial_ocr_status(extension: Column) -> Column:
    return F.when(has_extension(extension, DOCUMENTS + IMAGES), F.lit("pending")).otherwise(F.lit("not_needed"))
