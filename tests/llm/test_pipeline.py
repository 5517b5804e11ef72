import corpus_pipeline
import pandas as pd


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("toxicity", "line dedup", "near dedup", "packing")
    clean = stages[1](spark, docs, sf)
    assert sorted(clean.columns) == sorted(docs.columns) and clean.count() == docs.count()
    one = stages[2](spark, docs.unionByName(docs), sf)
    assert sorted(one.columns) == sorted(docs.columns) and one.count() <= docs.select("text").distinct().count()


def test_run(spark, sf):
    out: pd.DataFrame = corpus_pipeline.run(spark, sf).toPandas()
    assert len(out) and out.groupby("sequence_id")["length"].sum().max() <= 2048
