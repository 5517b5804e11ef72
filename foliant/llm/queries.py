"""Queries over the training-data operators, one for each, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import chunk_bpe, context_mix, gif_media, line_spread, native_simhash, simhash_bk, token_store, toxicity, vector_pack, warc_index
from foliant.llm.common import documents
from foliant.session import ship


def op1_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.group(documents(spark, sf_dir, "doc_id", "text"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return token_store.read(token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op10_vector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pack.pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.digests(gif_media.store(documents(spark, sf_dir, "doc_id", "text")))


def op6_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc_index.read(warc_index.write(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op5_native_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_simhash.edited(documents(spark, sf_dir, "doc_id", "text"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.clean(documents(spark, sf_dir, "doc_id", "source", "text"), counts=("n_lines", "n_removed"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model, "score")
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_context_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mix.score(documents(spark, sf_dir, "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.first IS NULL OR g.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first <> d.page_id THEN g.first END AS refers_to
FROM d LEFT JOIN g ON g.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
"""


OP7_SQL = """
WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
                  unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l),
b AS (SELECT k, min(doc_id) AS first FROM t WHERE length(k) >= 20 GROUP BY 1 HAVING count(DISTINCT source) >= 3),
m AS (SELECT t.*, b.first IS NOT NULL AND t.doc_id <> b.first AS gone FROM t LEFT JOIN b ON t.k = b.k),
d AS (SELECT doc_id, count(*)::INTEGER AS n_lines, (count(*) FILTER (gone))::INTEGER AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text)::INTEGER AS n_chars, sha256(text) AS text_sha256 FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_line_spread": OP7_SQL, "op8_warc_index": OP8_SQL}
