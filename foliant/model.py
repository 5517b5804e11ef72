"""The data model, and views of the driver tables that have its shape.

files(id, path, filename, extension, size, created_date, modified_date, hash, indexing_status, ocr_status, is_favorite),
document_text(file_id, extracted_text), tags(file_id, tag), changes(ts, seq, action, path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.paths import initial_ocr_status
from foliant.session import ship

EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "csv", "md"]

#: The same views in SQL.
FILES_SQL = """f0 AS (SELECT doc_id AS id, list_extract(['pdf','doc','docx','xls','xlsx','ppt','pptx','txt','rtf','csv','md'], (doc_id % 11 + 1)::INTEGER) AS extension, lang, source, text, n_chars FROM documents),
files AS (SELECT id, '/corpus/' || lang || '/' || source || '/' || source || '_' || id || '.' || extension AS path, source || '_' || id || '.' || extension AS filename, extension,
 n_chars AS size, (1704067200 + (id * 7919) % 63072000)::BIGINT AS modified_date, sha256(text) AS hash,
 CASE id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'metadata_only' WHEN 2 THEN 'failed' ELSE 'content_done' END AS indexing_status,
 CASE WHEN id % 7 = 0 THEN 'done' ELSE 'pending' END AS ocr_status, id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS is_favorite FROM f0)"""
TAGS_SQL = """tags AS (SELECT doc_id AS file_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS tag FROM labels UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"""
TOKENS_SQL = "regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.lit(True).alias("bought")).distinct()
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 11 + 1).cast("int"))
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    step = F.col("doc_id") % 10
    out = d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("/corpus/"), "lang", F.lit("/"), "source", F.lit("/"), name).alias("path"), name.alias("filename"), ext.alias("extension"), F.col("n_chars").alias("size"),
        (F.lit(1704067200) + (F.col("doc_id") * 7919) % 63072000).cast("long").alias("modified_date"), F.sha2("text", 256).alias("hash"),
        F.when(step == 0, "pending").when(step == 1, "metadata_only").when(step == 2, "failed").otherwise("content_done").alias("indexing_status"), F.when(F.col("doc_id") % 7 == 0, "done").otherwise("pending").alias("ocr_status"),
    )
    return out.join(bought, "id", "left").withColumn("is_favorite", F.coalesce("bought", F.lit(False))).drop("bought")


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("extracted_text"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels")
    rated = t.select(F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("tag"))
    return rated.unionByName(t.where("toxic = 1").select(F.col("doc_id").alias("file_id"), F.lit("toxic").alias("tag"))).distinct()


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "signup", "added").when(kind == "click", "modified").when(kind == "purchase", "renamed").when(kind == "error", "deleted")
    return table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path")).where("action is not null")


def records(files: DataFrame, paths: list[str]) -> DataFrame:
    return files.where(F.col("path").isin(paths)).withColumn("initial_ocr", initial_ocr_status(F.col("extension")))
