import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["search_ranked_and", "search_not", "search_tag_semi", "filename_search", "upsert_guarded", "duplicates_by_hash", "pivot_cross", "rename_pairing", "bm25_csv", "jd_classify", "mastery_levels"]


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_like_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
