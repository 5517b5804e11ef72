"""A corpus pipeline of training-data operators: toxicity, line dedup, near-dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` applies them in
order to ``documents``, each over all rows that the one before kept, with a written table between them.

Defined cases are those of the operators: null texts count as empty, null ids and repeated rows pass, except that
near-dedup keeps one row of each group; empty tables pass; extra columns of documents pass through the first three stages,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import line_spread, simhash_bk, toxicity, vector_pack
from foliant.llm.common import cut, numbered
from foliant.session import ship

TOXIC = 0.5  # documents with this score or more go


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled documents of the table, does not call toxic."""
    ship(spark)
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    flat, names = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), docs.columns
    text = numbered(docs, "text")[1][0]
    scored = toxicity.score(flat.withColumnRenamed(text, "text"), model, "score")
    return scored.where(F.col("score") < TOXIC).drop("score").toDF(*names)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; n_chars follows the text."""
    ship(spark)
    flat, (text, *_) = numbered(line_spread.clean(docs), "text")
    for k, field in enumerate(docs.schema):
        if field.name == "n_chars":
            flat = flat.withColumn(f"c{k}", F.length(text).cast(field.dataType))
    return flat.toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return simhash_bk.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    ship(spark)
    return vector_pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", clean_lines), ("near dedup", drop_near_copies), ("packing", pack)]

ORACLE_SQL = None  # a trained model and SimHash groups are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage-" + name.replace(" ", "-"))
    return docs
