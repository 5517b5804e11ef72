"""Ingest: from files to do, through extraction and the OCR slot, to texts and statuses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.paths import IMAGES, has_extension, needs_ocr
from foliant.operators import store

Ocr = Callable[[DataFrame], DataFrame]  # (file_id, path, content) to (file_id, ocr_text, ok)


def outcome(error: Column, ocr: Column) -> tuple[Column, Column]:
    """(indexing status, OCR status) after extraction."""
    failed = error != ""
    return F.when(failed, "failed").otherwise("content_done"), F.when(failed, "skipped").when(ocr, "pending").otherwise("not_needed")


def process(files: DataFrame, text: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, text) after extraction (path, extracted_text, text_source, needs_ocr, error) of some files to do.

    A file to do that extraction doesn't have is missing: failed, OCR skipped. Others are left as they are.
    """
    todo = store.todo(files).select("id", "path", "extension")
    got = todo.join(extracted, "path", "left").withColumn("error", F.when(F.col("extracted_text").isNull(), "missing").otherwise(F.coalesce("error", F.lit(""))))
    status, ocr = outcome(F.col("error"), needs_ocr(F.coalesce("needs_ocr", F.lit(False)), F.col("extracted_text"), F.col("extension")))
    marked = files.join(got.select("id", status.alias("_s"), ocr.alias("_o")), "id", "left")
    done = marked.withColumns({"indexing_status": F.coalesce("_s", "indexing_status"), "ocr_status": F.coalesce("_o", "ocr_status")}).drop("_s", "_o")
    return done, store.replace_text(text, got.where("error = ''").select(F.col("id").alias("file_id"), "extracted_text"))


def complete_ocr(files: DataFrame, text: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After OCR results (file_id, ocr_text, ok): a success replaces the text, a failure only sets the status."""
    marked = files.join(results.select(F.col("file_id").alias("id"), "ok"), "id", "left")
    done = marked.withColumn("ocr_status", F.when(F.col("ok"), "done").when(~F.col("ok"), "failed").otherwise(F.col("ocr_status"))).drop("ok")
    return done, store.replace_text(text, results.where("ok").select("file_id", F.col("ocr_text").alias("extracted_text")))


def waiting_for_ocr(files: DataFrame) -> DataFrame:
    return files.where("ocr_status = 'pending'").select(F.col("id").alias("file_id"), "path")


def combine(native: Column, ocr: Column) -> tuple[Column, Column]:
    """(text, source) of native and OCR text together."""
    a, b = F.coalesce(native, F.lit("")), F.coalesce(ocr, F.lit(""))
    return F.when(b == "", a).when(a == "", b).otherwise(F.concat(a, F.lit("\n"), b)), F.when(b == "", "native").when(a == "", "ocr").otherwise("native+ocr")


def requeue(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files at these paths (path) wait for extraction again; unknown paths come in as pending."""
    again = paths.select("path", F.lit(True).alias("_again")).distinct()
    return files.join(again, "path", "full_outer").withColumn("indexing_status", F.when(F.col("_again"), "pending").otherwise(F.col("indexing_status"))).drop("_again")


def batches(files: DataFrame, n: int) -> DataFrame:
    """Files to do with a column ``batch``: n at a time in order of id, by rank in hash buckets, so that no task orders all."""
    parts = 1024
    todo = store.todo(files).withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    before = todo.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")  # at most ``parts`` rows
    ranked = todo.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1)
    return ranked.join(F.broadcast(before), "_p").withColumn("batch", F.floor((F.col("_b") + F.col("_r")) / n)).drop("_p", "_r", "_b")


def drain(files: DataFrame, text: DataFrame, extract: Callable[[DataFrame], DataFrame], n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, text) after the files to do, or the first batch of n of them, went through ``extract`` (path) in one job.

    Failed files are not asked again; a later call takes what is still to do.
    """
    if n is None:
        return process(files, text, extract(store.todo(files).select("path")))
    first = batches(files, n).where("batch = 0").select("path")
    own = files.join(first, "path", "left_semi")
    done, new = process(own, text, extract(first))
    return files.join(first, "path", "left_anti").unionByName(done), new


def ocr_stage(files: DataFrame, text: DataFrame, read: Callable[[DataFrame], DataFrame], recognise: Callable[[bytes], str], tasks: int = 16) -> tuple[DataFrame, DataFrame]:
    """(files, text) after all images that wait for OCR went through ``recognise``, on at most ``tasks`` tasks at a time.

    read: (path) to (path, content). An exception of ``recognise`` is a failed file and nothing else.
    """
    waiting = files.where((F.col("ocr_status") == "pending") & has_extension(F.col("extension"), IMAGES)).select("id", "path")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, content in zip(p["id"], p["content"]):
                try:
                    rows.append((i, recognise(bytes(content)), True))
                except Exception:
                    rows.append((i, None, False))
            yield pd.DataFrame(rows, columns=["file_id", "ocr_text", "ok"])

    loaded = waiting.join(read(waiting.select("path")), "path").select("id", "content").repartition(tasks)
    return complete_ocr(files, text, loaded.mapInPandas(run, "file_id long, ocr_text string, ok boolean"))


def throttle_ms(actual: Column, target: Column) -> Column:
    """How long a worker rests at a processor load in percent: twice the points over the target, at most 150 ms."""
    return F.when(actual <= target, 0).otherwise(F.least(F.lit(150), (2 * (actual - target)).cast("int")))
