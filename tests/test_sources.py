import io
import zipfile

from pyspark.sql import functions as F

from foliant.sources import extract
from foliant.sources.snapshots import Snapshots, export_csv, read_csv, read_many


def packed(**parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k, v in parts.items():
            z.writestr(k.replace("__", "/").replace("_xml", ".xml"), v)
    return data.getvalue()


def test_office():
    docx = packed(word__document_xml='<w:d xmlns:w="u"><w:p><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:p><w:p><w:t>c</w:t></w:p></w:d>')
    assert extract.extract_one("DOCX", docx)[0] == "a\tb\n\nc\n"
    pptx = packed(ppt__slides__slide1_xml='<s xmlns:a="u"><a:p><a:t>x</a:t></a:p></s>', ppt__slides__slide3_xml="<s/>")
    assert extract.extract_one("pptx", pptx)[0] == "\nx \n"
    xlsx = packed(xl__worksheets__sheet1_xml='<w><c r="A1" t="inlineStr"><is><t>h</t></is></c><c r="B1"><v>1</v></c><c r="A2"><v>2</v></c></w>')
    assert extract.extract_one("xlsx", xlsx)[0] == "--- Sheet1 ---\nh\t1\t\n2\t\n"
    assert extract.extract_one("png", b"")[1:3] == ("ocr", True)
    assert extract.extract_one("doc", b"")[3] == "No extractor for doc"
    assert extract.extract_one("docx", b"junk")[3]
    assert extract.pages_text(["a", " ", ""])[1] and not extract.pages_text(["a", "b", ""])[1]


def test_scan_and_extract(spark, tmp_path):
    for p in ("file1.txt", "sub1/file2.md", "sub2/excluded/secret.txt", ".hidden.txt", "_notes.txt", ".hiddendir/x.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("héllo " + p)
    found = extract.scan(spark, [str(tmp_path)], [str(tmp_path / "sub2/excluded")])
    assert sorted(r["filename"] for r in found.collect()) == ["_notes.txt", "file1.txt", "file2.md"]
    assert extract.scan(spark, [str(tmp_path)], limit=2).count() == 2 and extract.scan(spark, [str(tmp_path / "none")]).count() == 0
    texts = extract.extract(extract.contents(spark, [str(tmp_path)]))
    assert texts.where(F.col("extracted_text").startswith("héllo")).count() == 4
    assert extract.content_hash(extract.contents(spark, [str(tmp_path)]), 10).count() == 4


def test_links_and_errors(spark, tmp_path):
    import hashlib
    import os

    (tmp_path / "real" / "deep").mkdir(parents=True)
    (tmp_path / "real" / "deep" / "a.txt").write_text("x" * 70_000)
    (tmp_path / "root").mkdir()
    os.symlink(tmp_path / "real", tmp_path / "root" / "link")
    os.symlink(tmp_path / "root", tmp_path / "real" / "loop")
    os.symlink(tmp_path / "gone", tmp_path / "root" / "broken")
    assert [r["filename"] for r in extract.scan(spark, [str(tmp_path / "root")]).collect()] == ["a.txt"]
    assert extract.scan(spark, [str(tmp_path / "root")], follow_links=False).count() == 0
    assert tuple(extract.scan_counts(spark, [str(tmp_path / "root")]).first()) == (1, 0)
    found = extract.scan(spark, [str(tmp_path / "real" / "deep")])
    assert extract.hashed(spark, found, 1).first()["hash"] == hashlib.sha256(b"x" * 65536).hexdigest()
    assert extract.hashed(spark, found).first()["hash"] == hashlib.sha256(b"x" * 70_000).hexdigest()


def test_other_rules(spark):
    docx = packed(word__document_xml='<w:d xmlns:w="u"><w:p><w:t> a</w:t><w:tab/><w:t>b </w:t></w:p><w:p/><w:p><w:t>c</w:t></w:p></w:d>')
    assert extract.docx_paragraphs(docx) == "ab\n\nc"
    slide = '<s xmlns:a="u"><a:p><a:t>{}</a:t></a:p></s>'
    pptx = packed(ppt__slides__slide2_xml=slide.format("two"), ppt__slides__slide10_xml=slide.format("ten"), ppt__slides__slide3_xml=slide.format(" "))
    assert extract.pptx_slides(pptx) == "[Slide 1]\nten\n\n[Slide 2]\ntwo"
    one = spark.createDataFrame([("/a.docx", docx), ("/b.pptx", pptx)], "path string, content binary")
    assert {r["path"]: r["extracted_text"] for r in extract.extract(one, extract.PARAGRAPHS).collect()}["/a.docx"] == "ab\n\nc"
    assert extract.page_records(["ab", None]) == [(1, 2, "ab"), (2, 0, "")]
    assert extract.table_records([[], [[[" a ", None]], []]]) == [(2, 0, 1, 2, [["a", ""]])]
    out = extract.records(one, lambda data: extract.page_records(["x", "yy"]), "page int, chars int, text string")
    assert sorted(tuple(r) for r in out.collect())[:2] == [("/a.docx", 1, 1, "x"), ("/a.docx", 2, 2, "yy")]


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.versions() == []
    s.write({"t": spark.range(3)})
    s.write({"t": spark.range(5)}, batch_id=7)
    assert s.read("t").count() == 5 and s.has_batch(7) and not s.has_batch(8)
    s.restore(1)
    assert s.read("t").count() == 3 and s.versions() == [3, 2, 1]
    s.clear()
    assert s.read("t").count() == 0
    h = s.history().collect()
    assert [r["version"] for r in h] == [4, 3, 2, 1] and all(r["bytes"] > 0 and r["written"] is not None for r in h)
    assert s._claim() == 5 and s.write({"t": spark.range(7).repartition(5)}) == 6  # another writer holds 5
    assert s.compact() == 7 and len(s.read("t").inputFiles()) == 1 and s.read("t").count() == 7
    assert [tuple(r) for r in s.analyze("t").collect()] == [("id", 7, 0)]
    export_csv(spark.createDataFrame([('a"b', 1)], "n string, k int"), str(tmp_path / "c"))
    assert read_csv(spark, str(tmp_path / "c"), "n string, k int").first()["n"] == 'a"b'
    (tmp_path / "messy.csv").write_text('made by hand\n\nn,k\nx,1\n"y, z",NA\nbad\nq,2,3\nw,notanumber\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "messy.csv"), "n string, k int", skip=2).collect()) == [("x", 1), ("y, z", None)]
    (tmp_path / "one.csv").write_text("n,k\na,1\n")
    (tmp_path / "two.csv").write_text("n,k\nb,2\nbad\n")
    both = read_many(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], "n string, k int")
    assert sorted(tuple(r) for r in both.collect()) == [("a", 1, "one.csv"), ("b", 2, "two.csv")]
