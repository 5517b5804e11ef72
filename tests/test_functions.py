import pytest
from pyspark.sql import functions as F

from foliant.functions import paths, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize("given, want", [("Hello WORLD", "hello world"), ("café résumé", "cafe resume"), ("  foo   bar  \n\t baz ", "foo bar baz"), ("", "")])
def test_normalize(spark, given, want):
    assert one(spark, text.normalize(L(given))) == want


def test_text(spark):
    assert one(spark, text.ascii_lower(L("文件NAME.PDF É"))) == "文件name.pdf É"
    assert one(spark, text.quote_phrase(L('a"b'))) == '"a""b"'
    assert one(spark, text.snippet_around(L("The quick brown fox jumps over the lazy dog."), "BROWN", 5, 5)) == "...uick brown fox ..."
    assert one(spark, text.strip_control(L("\x01A\x02\nB"))) == "A\nB"
    for n, want in ((0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (999 * 1024, "999.0 KB"), (12 << 20, "12.0 MB"), (5 << 30, "5.0 GB")):
        assert one(spark, text.format_size(L(n).cast("long"))) == want
    for given, want in (("Hello, World!", "hello_world"), ("Café Résumé", "cafe_resume"), ("  --foo--  ", "foo")):
        assert one(spark, text.slugify(L(given))) == want
    for a, b, n in (("", "", 0), ("", "abc", 3), ("ABC", "abc", 0), ("cat", "cot", 1), ("cats", "cat", 1)):
        assert one(spark, text.levenshtein(L(a), L(b))) == n
    for a, b, j in (("a b", "b a", 1.0), ("a", "b", 0.0), ("foo bar baz", "foo bar qux", 0.5), ("", "", 1.0), ("a", "", 0.0)):
        assert one(spark, text.jaccard(L(a), L(b))) == j


def test_snippet(spark):
    from foliant.plans.search import snippet

    words = [f"w{k}" for k in range(40)]
    show = lambda t, terms: one(spark, snippet(L(t), terms))
    assert show(" ".join(words), ["w20"]) == "..." + " ".join(words[12:28]) + "..."
    assert show(" ".join(words), ["none"]) == " ".join(words[:16]) + "..."
    assert show("a  b\n(Été), c", ["ete"]) == "a b (Été), c" and show("", ["x"]) == ""
    assert show(" ".join(words), ["w39", "w38"]) == "..." + " ".join(words[30:])


def test_paths(spark):
    for p, e in (("foo.pdf", "pdf"), ("foo.TXT", "txt"), ("foo.tar.gz", "gz"), ("README", ""), ("foo.", ""), ("C:/my.folder/file.txt", "txt"), ("foo.bar/baz", "")):
        assert one(spark, paths.extension_of(L(p))) == e
    for p, f, want in (("D:\\Movies\\movie.mp4", "D:\\Movies", True), ("D:\\Movies Archive\\x.mp4", "D:\\Movies", False), ("D:/Movies/sub/x.mp4", "D:\\Movies", True)):
        assert one(spark, paths.is_under_any(L(p), [f])) is want
    assert one(spark, F.unix_millis(paths.filetime(L(116444736000000000)))) == 0
    day = lambda s: L(s).cast("date")
    for e, d, band in (("pdf", "2025-06-30", 1), ("pdf", "2025-05-31", 1), ("pdf", "2025-05-30", 2), ("pdf", "2024-06-30", 2), ("pdf", "2024-06-29", 3), ("ZIP", "2025-06-30", 4), ("bz2", "1999-01-01", 4)):
        assert one(spark, paths.priority(L(e), day(d), day("2025-06-30"))) == band
    assert one(spark, paths.top_two(L("/a/b/c.txt"))) == "/a/b"
    assert one(spark, F.sha2(L("hello\n"), 256)).startswith("5891b5b5")
