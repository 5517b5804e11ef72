import random
import sqlite3

import pytest

from foliant.plans.parser import Leaf, Node, QuerySyntaxError, bytes_of, filename_words, leaves, parse, split_fields, tokenize


@pytest.mark.parametrize(
    "raw, fts",
    [
        ("", ""), ("   ", ""), ("NOC", '"NOC"'), ("NOC examination", '"NOC" "examination"'), ('"Station Development"', '"Station Development"'),
        ('"a""b"', '"a" "b"'), ("NOC AND examination", '"NOC" AND "examination"'), ("NOC OR x", '"NOC" OR "x"'), ("NOC NOT x", '"NOC" NOT "x"'),
        ("NOC -draft", '"NOC" NOT "draft"'), ("rail*", "rail*"), ("type:pdf folder:Railway NOC examination", '"NOC" "examination"'), ("colour:red blue", '"blue" "red"'),
        ('foo"bar baz"', '"foo""bar" "baz"""'), ("a -", '"a" NOT ""'), ("colour:", '""'), ("a colour: b", '"a" "b" ""'), ("C:\\x http://a", '"\\x" "//a"'), ('"open end', '"open end"'), ("and or", '"and" "or"'), ('x""', '"x"""""'),
    ],
)
def test_expression(raw, fts):
    assert parse(raw).fts == fts


def test_fields():
    q = parse('type:PDF folder:"My Documents" date:2026-06-15 fav:1 ocr:1 tag:"For Review" size:1MB-10MB x')
    assert (q.extension, q.folder, q.date, q.favorite, q.ocr, q.tag) == ("pdf", "My Documents", "2026-06-15", True, True, "For Review")
    assert (bytes_of(q.min_size), bytes_of(q.max_size)) == (1 << 20, 10 << 20)
    assert parse("favorite:").favorite and parse("tag:").tag is None and parse("ext:docx").extension == "docx" and parse("path:project").folder == "project"
    assert parse("favorite:0").favorite is False and parse("fav:TRUE").favorite


def test_tree():
    a, b, c = Leaf(("noc",)), Leaf(("draft",)), Leaf(("railway",))
    assert parse("NOC -draft railway").tree() == Node("NOT", (a, Node("group", (b, c))))
    assert parse("ra*il").tree() == Node("group", (Leaf(("ra",), True), Leaf(("il",))))
    assert parse("a-b").tree() == Leaf(("a", "b"))
    assert leaves(parse("a OR a b").tree()) == [Leaf(("a",)), Leaf(("b",))]


@pytest.mark.parametrize("raw", ["-x", "a OR NOT b", "a AND", "OR a", "foo-b*", "a.b*", "*"])
def test_errors(raw):
    with pytest.raises(QuerySyntaxError):
        parse(raw).tree()


def test_filename_words():
    assert filename_words('type:pdf a+b "c d" AND -draft rail*') == ["a", "b", "c d", "-draft", "rail*"]
    assert filename_words("type:pdf") == []
    assert filename_words('"a""b" foo"bar baz" colour:') == ["a", "b", 'foo"bar', 'baz"', "colour:"]


def test_split_fields():
    assert split_fields('one type:PDF two three tag:"For Review" ') == ([("type", "PDF"), ("tag", "For Review")], ["one", "two three"])
    assert split_fields("plain words") == ([], ["plain words"]) and split_fields("Size:>1 ") == ([("size", ">1")], [])


def test_empty_expression_matches_nothing(spark):
    from foliant.plans.search import search

    files = spark.createDataFrame([(1, "/a", "a.txt", "txt", 1, 1, False, "")], "id long, path string, filename string, extension string, size long, modified_date long, is_favorite boolean, ocr_status string")
    text = spark.createDataFrame([(1, "words")], "file_id long, extracted_text string")
    assert search(files, text, "colour:").count() == 0 and search(files, text, "type: txt").count() == 1
    assert [r["source"] for r in search(files, text, "words -").collect()] == [0]


def test_tokenize():
    assert tokenize("Café-Résumé x_1 ½") == ["cafe", "resume", "x", "1", "½"]


def test_ranks_like_fts5(spark):
    """Boolean, phrase and prefix queries give the ids and scores of SQLite's FTS5."""
    from pyspark.sql import functions as F

    from foliant.plans import fts

    r = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(1, 4))), " ".join(r.choices(words, weights=range(12, 0, -1), k=r.randint(0, 15)))) for i in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(filename, content, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, filename, content) VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id long, filename string, content string").cache()
    asked = ["w1", "w1 w2", "w3 OR w4 w5", "w1 NOT w2 w3", '"w0 w1"', '"w1 w1" OR w9', "w1*", "w10 AND w1*", "w2 w2", '"w0 w1 w0" OR w11', "w5 NOT w1 NOT w2", '"-" w3']
    for raw in asked:
        q = parse(raw)
        want = {i: s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (q.fts,))}
        got = {x["id"]: x["score"] for x in fts.match(df, q.tree(), ["filename", "content"]).select("id", F.col("score").cast("double").alias("score")).collect()}
        assert got.keys() == want.keys(), raw
        assert all(abs(got[i] - want[i]) < 1e-9 for i in got), raw


def test_index_equals_scan(spark, tmp_path):
    from foliant.plans import fts
    from foliant.plans.index import Index

    r = random.Random(6)
    rows = [(i, f"f{i % 3} w1", " ".join(r.choices(["w0", "w1", "w2", "wx"], k=r.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, filename string, content string")
    index = Index.build(df, str(tmp_path / "i"), "id", ["filename", "content"])
    for raw in ("w0 w2", '"w1 w2"', "w* NOT w0", '"w0 w1" OR wx'):
        tree = parse(raw).tree()
        scan = {x["id"]: round(x["score"], 9) for x in fts.match(df, tree, ["filename", "content"]).collect()}
        assert {x["id"]: round(x["score"], 9) for x in index.match(tree).collect()} == scan, raw


def test_index_changes(spark, tmp_path):
    """After updates, removals and compaction the index answers as a scan of the rows that are left."""
    from foliant.plans import fts
    from foliant.plans.index import Index, words_of

    r = random.Random(7)
    text = lambda: " ".join(r.choices(["w0", "w1", "w2", "ete"], k=r.randint(0, 9)))
    rows = {i: (i, f"f{i % 3}", text()) for i in range(50)}
    table = lambda x: spark.createDataFrame(list(x), "id long, filename string, content string")
    index = Index.build(table(rows.values()), str(tmp_path / "i"), "id", ["filename", "content"])

    def same():
        assert (index.n, index.tokens) == (len(rows), sum(len(words_of(f)) + len(words_of(c)) for _, f, c in rows.values()))
        for raw in ("w0 w2", '"w1 w2"', "w* NOT w0", "f1 OR ete"):
            tree = parse(raw).tree()
            scan = {x["id"]: round(x["score"], 9) for x in fts.match(table(rows.values()), tree, ["filename", "content"]).collect()}
            assert {x["id"]: round(x["score"], 9) for x in index.match(tree).collect()} == scan, raw

    same()
    new = {i: (i, "f9 w0", text()) for i in (3, 4, 60)}
    rows |= new
    index.update(table(new.values()), "id", spark.createDataFrame([(7,), (8,), (3,), (99,)], "id long"))
    rows = {k: v for k, v in rows.items() if k not in (7, 8)}
    same()
    index.delete(spark.createDataFrame([(60,), (0,)], "id long"))
    del rows[60], rows[0]
    same()
    other = Index(spark, str(tmp_path / "i"))
    index.compact()
    same()
    other.refresh()
    assert len(other.segments) == 1 and other.n == len(rows)
    assert index.match(parse('""').tree() or Leaf(())).count() == 0


def test_words_like_the_tokenizer():
    from foliant.plans.index import words_of

    for t in ("Café-Résumé x_1 ½", "ÉTÉ İstanbul ﬁ ²", "plain Text_with under_scores 42", "", "日本語 テスト", "a\u0301b \ue000x"):
        assert words_of(t) == tokenize(t)
