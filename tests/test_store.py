import pytest
from pyspark.sql import functions as F

from foliant.operators import frames, rules, store

FILES = "id long, path string, filename string, extension string, size long, modified_date long, hash string, indexing_status string"


@pytest.fixture()
def files(spark):
    return spark.createDataFrame([(1, "/a", "a", "", 100, 10, "h1", "content_done"), (2, "/b", "b", "", 100, 10, "h1", "pending"), (3, "/c", "c", "", 5, 1, "h2", "failed"), (4, "/d", "d", "", 5, 1, "", "failed"), (5, "/e", "e", "", 5, 1, "", "failed")], FILES)


def test_upsert(spark, files):
    new = spark.createDataFrame([("/a", "a", "", 100, 5, "x"), ("/b", "b", "", 200, 5, "x"), ("/c", "c", "", 5, 9, "x"), ("/n", "n", "", 1, 1, "x")], "path string, filename string, extension string, size long, modified_date long, hash string")
    out = store.number_new(store.upsert(files, new))
    rows = {r["path"]: r for r in out.collect()}
    assert {p: r["change"] for p, r in rows.items()} == {"/a": "kept", "/b": "updated", "/c": "updated", "/d": "kept", "/e": "kept", "/n": "inserted"}
    assert rows["/b"]["size"] == 200 and rows["/b"]["indexing_status"] == "pending" and rows["/n"]["id"] == 6


def test_upsert_folds_new_rows_of_one_path(spark, files):
    new = spark.createDataFrame([("/n", "n", "", 1, 5, "old"), ("/n", "n", "", 2, 9, "last"), ("/n", "n", "", 2, 9, "last"), ("/a", "a", "", 100, 5, "x"), ("/a", "a", "", 100, 99, "y")], "path string, filename string, extension string, size long, modified_date long, hash string")
    rows = [r for r in store.number_new(store.upsert(files, new)).collect()]
    assert sorted((r["path"], r["hash"], r["change"]) for r in rows if r["path"] in ("/n", "/a")) == [("/a", "y", "updated"), ("/n", "last", "inserted")]
    many = spark.range(300).selectExpr("concat('/m', id) AS path", "'f' AS filename", "'' AS extension", "1L AS size", "1L AS modified_date", "'h' AS hash")
    ids = [r["id"] for r in store.number_new(store.upsert(files, many)).where("change = 'inserted'").collect()]
    assert sorted(ids) == list(range(6, 306))


def test_favorites_and_content(spark, tmp_path):
    from foliant.plans.index import Index
    from foliant.plans.parser import parse

    files = spark.createDataFrame([(1, "a.txt", "pending", "", False), (2, "b.txt", "pending", "", True)], "id long, filename string, indexing_status string, ocr_status string, is_favorite boolean")
    text = spark.createDataFrame([(1, "old words")], "file_id long, extracted_text string")
    assert {r["id"] for r in store.set_favorite(files, files.where("id = 1")).where("is_favorite").collect()} == {1, 2}
    assert store.set_favorite(files, files.where("id = 2"), False).where("is_favorite").count() == 0
    index = Index.build(files.select("id", "filename").join(text.withColumnRenamed("file_id", "id"), "id", "left"), str(tmp_path / "i"), "id", ["filename", "extracted_text"])
    done, now = store.set_content(files, text, spark.createDataFrame([(1, "fresh words"), (2, "more")], "file_id long, extracted_text string"), indexing="content_done", ocr="done", index=index)
    assert done.where("indexing_status = 'content_done' and ocr_status = 'done'").count() == 2 and now.count() == 2
    hits = lambda q: sorted(r["id"] for r in index.match(parse(q).tree()).collect())
    assert hits("fresh") == [1] and hits("old") == [] and hits("more") == [2] and hits("txt") == [1, 2]


def test_state(spark, files):
    tags = spark.createDataFrame([(1, "x"), (2, "y")], "file_id long, tag string")
    more = store.add_tags(tags, spark.createDataFrame([(1, " x "), (1, "z"), (1, " ")], "file_id long, tag string"))
    assert {r["file_id"]: r["tags"] for r in store.tags_by_file(more).collect()} == {1: ["x", "z"], 2: ["y"]}
    assert store.remove_tag(more, 1, "z").count() == 2
    left = store.delete(files.where("id = 1").select("id"), files, tags=more)
    assert left["files"].count() == 4 and left["tags"].count() == 1
    assert [tuple(r) for r in store.duplicates(files).collect()] == [("h1", 2, 1)]
    assert [(r["hash"], r["n"], r["ids"]) for r in store.duplicate_ids(files).collect()] == [("h1", 2, [1, 2])]
    assert [(r["hash"], r["n"], r["ids"]) for r in store.duplicate_ids(files, most=1).collect()] == [("h1", 2, None)]
    assert store.duplicates_expanded(files).count() == 2
    assert store.pending(files).first()["id"] == 2
    with pytest.raises(ValueError):
        store.set_status(files, files.select("id"))
    done = store.set_status(files, files.where("id = 2").select("id"), indexing="content_done")
    assert done.where("indexing_status = 'content_done'").count() == 2
    notes = spark.createDataFrame([(1, "old")], "file_id long, note string")
    notes = store.set_notes(notes, spark.createDataFrame([(1, "new"), (2, "n")], "file_id long, note string"))
    assert {r["id"]: (r["tags"], r["note"]) for r in store.record(files.where("id < 4"), more, notes).collect()} == {1: (["x", "z"], "new"), 2: (["y"], "n"), 3: ([], "")}


def test_searches(spark):
    empty = spark.createDataFrame([], "id long, search_name string, search_query string, created_at long")
    one = store.save_search(empty, "a", "q", 5)
    again = store.save_search(one, "a", "q2", 9)
    assert [tuple(r) for r in again.collect()] == [(1, "a", "q2", 5)]
    two = store.save_search(again, "b", "z", 9)
    with pytest.raises(ValueError):
        store.rename_search(two, "a", "b")
    assert store.rename_search(two, "a", "c").where("search_name = 'c'").count() == 1 and store.delete_search(two, "a").count() == 1
    log = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), (" ", 4)], "query string, at long")
    assert [r["query"] for r in store.recent_searches(log).collect()] == ["x", "y"]


def test_saved_search_by_name(spark):
    from foliant.plans.search import run_saved

    files = spark.createDataFrame([(1, "/a", "a.txt", "txt", 1, 1, False, "")], "id long, path string, filename string, extension string, size long, modified_date long, is_favorite boolean, ocr_status string")
    text = spark.createDataFrame([(1, "some words")], "file_id long, extracted_text string")
    saved = store.save_search(spark.createDataFrame([], "id long, search_name string, search_query string, created_at long"), "mine", "words", 5)
    assert [r["id"] for r in run_saved(saved, "mine", files, text).collect()] == [1]
    with pytest.raises(KeyError):
        run_saved(saved, "other", files, text)


def test_changes(spark):
    raw = spark.createDataFrame([("r", 1, "old_name", "a"), ("r", 2, "new_name", "b"), ("r", 3, "new_name", "c"), ("r", 4, "added", "d"), ("r", 5, "old_name", "e")], "root string, seq long, action string, path string")
    got = [tuple(r) for r in store.pair_renames(raw).select("seq", "action", "path", "new_path").orderBy("seq").collect()]
    assert got == [(1, "renamed", "a", "b"), (4, "added", "d", None), (5, "deleted", "e", None)]


def test_frames(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "n/a"), (None, "x", "2.005")], "k string, c string, v string")
    assert {r["k"]: r["sum_v"] for r in frames.pivot_flat(df, ["k"], {"v": "sum"}).collect()} == {"a": 1.0, "None": 2.0}
    assert {r["k"]: (r["x"], r["y"]) for r in frames.pivot_cross(df, ["k"], "c", "v", "sum", ["x", "y"]).collect()}["a"] == (1.0, 0.0)
    held = frames.split_holdout(spark.range(10).withColumn("s", F.col("id") % 2), "s", "id", 0.4).where("held").count()
    assert held == 4


def test_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(rules.domain_of(F.lit("a bar chart"))) == "chart" and one(rules.domain_of(F.lit("zzz"))) == "style"
    assert one(rules.a1_column(F.lit("AA10"))) == 27 and one(rules.a1_row(F.lit("AA10"))) == 10
    tries = spark.createDataFrame([("k", i, a) for i, a in enumerate([1.0, 0.9, 0.2, 0.3, 0.8, 0.9])], "k string, i int, a double")
    r = rules.mastery(tries, "k", "i", "a").first()
    assert (r["level"], r["stage"], r["weak"], r["best"]) == (3, 2, False, 1.0)
    import itertools

    every = [(f"{n}-{''.join(map(str, p))}", i, a) for n in (1, 2, 3, 4, 12) for p in itertools.islice(itertools.product((0.2, 0.55, 0.7, 0.9), repeat=n), 0, 300) for i, a in enumerate(p)]
    got = {r["k"]: r for r in rules.mastery(spark.createDataFrame(every, "k string, i int, a double"), "k", "i", "a").collect()}
    for k, group in itertools.groupby(every, key=lambda x: x[0]):
        level, stage, weak, before = 1, 0, False, None
        said = [a for _, _, a in group]
        for a in said:
            level, stage = (min(3, level + 1), min(4, stage + 1)) if a >= 0.6 else (max(1, level - 1), 0)
            if (before is not None and before < 0.6 and a < 0.6) or a < 0.5:
                weak = True
            elif before is not None and before >= 0.8 and a >= 0.8:
                weak = False
            before = a
        assert (got[k]["level"], got[k]["stage"], got[k]["weak"], got[k]["history"]) == (level, stage, weak, said[-10:]), k
    assert one(rules.market_of(F.lit("600000"))) == "CN" and one(rules.market_of(F.lit("0700.hk"))) == "HK"


def test_dominant_breaks_ties_by_the_whole_pattern(spark):
    df = spark.createDataFrame([("k", "AB"), ("k", "AA"), ("j", "B"), ("j", "B"), ("j", "A")], "k string, p string")
    assert sorted(tuple(r) for r in rules.dominant(df, "k", "p").collect()) == [("j", "B", 1), ("k", "AA", 1)]


def test_quantiles(spark):
    import random

    r = random.Random(1)
    values = [r.choice([1.0, 2.0, 2.0, r.random() * 100]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    import numpy as np

    for rows in (1000, 20):  # in one bracket, and narrowed
        got = frames.quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0], rows)
        assert np.allclose(got, np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0]))
    assert frames.quantiles(df.where("v < 0"), "v", [0.5]) == [None]


def test_cross_pivot_headers(spark):
    df = spark.createDataFrame([("a", "y", "1", 2), ("a", "x", "2", 3), ("b", "y", "z", 4)], "k string, c string, v string, w int")
    out = frames.pivot_cross(df, ["k"], "c", {"v": "sum", "w": "max"})
    assert out.columns == ["k", "x (v sum)", "x (w max)", "y (v sum)", "y (w max)"]
    assert {r["k"]: tuple(r)[1:] for r in out.collect()} == {"a": (2.0, 3.0, 1.0, 2.0), "b": (0.0, 0.0, 0.0, 4.0)}
    with pytest.raises(ValueError):
        frames.pivot_cross(df, ["k"], "c", "v", "sum", most=1)


def test_skills_like_a_plain_reading(spark, sf):
    import re

    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    texts += [(-1, "Spark, spark; C++ node.js x a-b 数据分析 机器学习模型 本科 the AND 12ab"), (-2, ""), (-3, "été_x über-Cool zz")]
    got = {}
    for r in rules.skills(spark.createDataFrame(texts, "k long, t string"), "k", "t").orderBy("k", "no").collect():
        got.setdefault(r["k"], []).append(r["skill"])
    for k, t in texts:
        want, seen = [], set()
        for w in re.findall(r"\b[A-Za-z][A-Za-z0-9+/.\-_#]{1,20}\b", t) + re.findall(r"[一-龥]{2,5}", t):
            if w.lower() not in seen and w not in rules.NO_SKILLS:
                seen.add(w.lower())
                want.append(w)
        assert got.get(k, []) == want[:60], k


def test_gaps_points_and_questions(spark):
    df = spark.createDataFrame([(1, "I know Pathology well"), (2, "a path of 深度 things"), (3, "")], "k int, t string")
    got = {(r["k"], r["keyword"]): r["kind"] for r in rules.gaps(df, "k", "t", ["pathology", "深度模型", "pathology"]).collect()}
    assert got == {(1, "pathology"): "perfect", (1, "深度模型"): "missing", (2, "pathology"): "implicit", (2, "深度模型"): "implicit", (3, "pathology"): "missing", (3, "深度模型"): "missing"}
    answers = spark.createDataFrame([(["p", "q"], 1.0), (["p"], 0.0), (["q"], None)], "kp array<string>, s double")
    assert {r["point"]: (r["n"], r["accuracy"]) for r in rules.accuracy_by_point(answers, "kp", "s").collect()} == {"p": (2, 0.5), "q": (1, 1.0)}
    raw = spark.createDataFrame([('```json\n[{"prompt": "x"}]\n```',), ('[{"id":"a","level":3,"options":["u"]}, {}]',), ("no json",), ('{"id":"a"}',)], "raw string")
    out = [r["q"] for r in raw.select(rules.questions(F.col("raw")).alias("q")).collect()]
    assert [(q["id"], q["level"], q["type"], q["options"], q["prompt"]) for q in out[0]] == [("q_unknown", 1, "single_choice", [], "x")]
    assert [(q["id"], q["level"], q["options"]) for q in out[1]] == [("a", 3, ["u"]), ("q_unknown", 1, [])] and out[2] is None
