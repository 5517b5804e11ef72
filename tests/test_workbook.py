from foliant.operators import stories, workbook
from pyspark.sql import functions as F

CELLS = "book string, sheet string, row long, col int, formula string, value string"


def kinds(df):
    return sorted((r["sheet"], r["row"], r["col"], r["finding"]) for r in df.collect())


def test_cells(spark):
    rows = [
        ("b", "S", 1, 1, None, "name"), ("b", "S", 1, 2, "=SUM(A1:A2)", "0"), ("b", "S", 2, 1, "=SUM(A1:B900)", "#DIV/0! x"), ("b", "S", 3, 1, "=T!A1:B900", "1"), ("b", "S", 4, 1, "=hello", "1"),
        ("b", "S", 5, 1, "='[my.XLSX]A'!B2 + filter (A1)", "1"), ("b", "S", 6, 1, '=" text"', "1"), ("b", "S", 7, 1, "=match( TRUE(), A1:A3)", "0.0"), ("b", "T", 400, 28, None, "x"), ("b", "S", 8, 1, None, None),
    ]
    cells = spark.createDataFrame(rows, CELLS)
    assert kinds(workbook.validate(cells)) == [("S", 4, 1, "text_as_formula"), ("S", 5, 1, "external_file_ref"), ("S", 5, 1, "forbidden_function")]
    assert kinds(workbook.audit(cells)) == [("S", 1, 2, "zero"), ("S", 2, 1, "error"), ("S", 7, 1, "implicit_array"), ("S", 7, 1, "zero")]
    assert kinds(workbook.scan(cells)) == [("S", 1, 2, "small_aggregate"), ("S", 2, 1, "header_included"), ("S", 2, 1, "out_of_range")]
    one = {r["sheet"]: tuple(r)[2:] for r in workbook.inspect(cells).collect()}
    assert one == {"S": ("A1:B7", 7, 2, 6, 6, ["name", "=SUM(A1:A2)"]), "T": ("A1:AB400", 400, 28, 1, 0, [])}
    parts = spark.createDataFrame([("b", "x/_rels/a.rels", '<R Target="C:\\x" /> FILE:///y'), ("b", "a.xml", "file:///")], "book string, part string, content string")
    assert sorted(r["finding"] for r in workbook.relations(parts).collect()) == ["absolute_path", "local_file_ref"]


def test_cell_names(spark):
    one = lambda n: spark.range(1).select(workbook.a1(F.lit(5), F.lit(n)).alias("x")).first()["x"]
    assert [one(n) for n in (1, 26, 27, 52, 53, 702, 703, 18278)] == ["A5", "Z5", "AA5", "AZ5", "BA5", "ZZ5", "AAA5", "ZZZ5"]


def test_sections(spark):
    text = "# One\nintro Day 1 x night  2 y 3 weeks LATER. Morning of Day 4 **When:** noon\n**Date:** May\nend"
    rows = spark.createDataFrame([(1, text), (2, "nothing here"), (3, ""), (4, None)], "k int, t string")
    got = [(r["pos"], r["kind"], r["marker"]) for r in stories.markers(rows, "k", "t").where("k = 1").orderBy("pos", "kind").collect()]
    # every pattern for itself, so a place may be named twice
    want = sorted((m.start(), k, m[1].strip()) for k, p in enumerate(stories.MARKERS) for m in __import__("re").finditer(p, text, __import__("re").I))
    assert got == want and len(got) == 7
    cut = stories.sections(rows, "k", "t").orderBy("k", "no").collect()
    first = [r for r in cut if r["k"] == 1]
    assert [r["start"] for r in first] == [w[0] for w in want] and sum(r["length"] for r in first) == len(text) - want[0][0]
    assert all(r["preview"] == text[r["start"] : r["start"] + r["length"]] and r["chapter"] == "One" for r in first)
    assert [(r["k"], r["timepoint"], r["length"], r["chapter"]) for r in cut if r["k"] > 1] == [(2, None, 12, "2"), (3, None, 0, "3"), (4, None, 0, "4")]


def test_profiles_and_issues(spark):
    texts = spark.createDataFrame([("# Ann Lee\n**Age:** 30 years\nHair: Black, long\n**Nicknames:** Annie; Al , ",), ("no title",), ("# Bo\n**Role:** cook",)], "t string")
    known = stories.profiles(texts, F.col("t"))
    got = {r["name"]: r.asDict() for r in known.collect()}
    assert got.keys() == {"Ann Lee", "Bo"} and got["Ann Lee"]["age"] == "30 years" and got["Ann Lee"]["hair"] == "Black" and got["Ann Lee"]["aliases"] == ["Annie", "Al"] and got["Bo"]["age"] is None
    tales = spark.createDataFrame([(1, "ann lee is a 25 year old. Ann Lee has red hair."), (2, "Ann Lee, 30 years on. Her hair is black"), (3, "Bob and Annlee"), (4, "BO cooks")], "k int, t string")
    assert sorted((r["k"], r["name"]) for r in stories.mentions(tales, "k", "t", known).collect()) == [(1, "Ann Lee"), (2, "Ann Lee"), (4, "Bo")]
    assert sorted((r["k"], r["issue"], r["detail"]) for r in stories.issues(tales, "k", "t", known).collect()) == [(1, "age", "25"), (1, "capitals", "ann lee"), (1, "hair", "Ann Lee has red hair"), (4, "capitals", "BO")]
    parts = stories.sections(tales, "k", "t")
    assert sorted((r["name"], r["k"]) for r in stories.by_character(parts, known, "k").collect()) == [("Ann Lee", 1), ("Ann Lee", 2), ("Bo", 4)]
