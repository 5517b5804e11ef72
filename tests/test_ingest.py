from pyspark.sql import functions as F

from foliant.operators import ingest, rules

FILES = "id long, path string, extension string, indexing_status string, ocr_status string"


def test_process_and_ocr(spark):
    files = spark.createDataFrame([(1, "/a.txt", "txt", "pending", ""), (2, "/b.pdf", "pdf", "pending", ""), (3, "/c.doc", "doc", "pending", ""), (4, "/d.txt", "txt", "content_done", "x"), (5, "/e.txt", "txt", "metadata_only", "")], FILES)
    text = spark.createDataFrame([(1, "old")], "file_id long, extracted_text string")
    got = spark.createDataFrame([("/a.txt", "new", "native", False, ""), ("/b.pdf", "", "native", True, ""), ("/c.doc", "", "native", False, "No extractor for doc")], "path string, extracted_text string, text_source string, needs_ocr boolean, error string")
    files, text = ingest.process(files, text, got)
    assert {r["id"]: (r["indexing_status"], r["ocr_status"]) for r in files.collect()} == {1: ("content_done", "not_needed"), 2: ("content_done", "pending"), 3: ("failed", "skipped"), 4: ("content_done", "x"), 5: ("failed", "skipped")}
    assert {r["file_id"]: r["extracted_text"] for r in text.collect()} == {1: "new", 2: ""}
    assert [r["file_id"] for r in ingest.waiting_for_ocr(files).collect()] == [2]
    files, text = ingest.complete_ocr(files, text, spark.createDataFrame([(2, "seen", True), (1, "", False)], "file_id long, ocr_text string, ok boolean"))
    assert {r["id"]: r["ocr_status"] for r in files.where("id < 3").collect()} == {1: "failed", 2: "done"}
    assert {r["file_id"]: r["extracted_text"] for r in text.collect()} == {1: "new", 2: "seen"}
    again = ingest.requeue(files, spark.createDataFrame([("/d.txt",), ("/n.txt",)], "path string"))
    assert again.where("indexing_status = 'pending'").count() == 2


def test_combined_text_and_kinds(spark):
    t, s = ingest.combine(F.lit("a"), F.lit("b"))
    r = spark.range(1).select(t.alias("t"), s.alias("s"), rules.story_kinds(F.lit("失败 and 学习")).alias("k"), rules.fuzzy_part(F.lit("深度学习"), "深度模型").alias("f")).first()
    assert tuple(r) == ("a\nb", "native+ocr", ["failure", "learning"], "深度")


def test_batches_and_ocr_stage(spark):
    files = spark.createDataFrame([(i, f"/{i}.txt", "txt", "pending", "") for i in range(10)] + [(20, "/p.png", "png", "content_done", "pending"), (21, "/q.png", "png", "content_done", "pending")], FILES)
    text = spark.createDataFrame([], "file_id long, extracted_text string")
    sizes = {r["batch"]: r["count"] for r in ingest.batches(files, 4).groupBy("batch").count().collect()}
    assert sorted(sizes.values()) == [2, 4, 4]
    ok = lambda paths: paths.selectExpr("path", "'t' AS extracted_text", "'native' AS text_source", "false AS needs_ocr", "'' AS error")
    once, some = ingest.drain(files, text, ok, 4)
    assert once.where("indexing_status = 'content_done'").count() == 6 and some.count() == 4 and once.count() == 12
    every, texts = ingest.drain(once, some, ok)
    assert every.where("indexing_status = 'pending'").count() == 0 and texts.count() == 10
    read = lambda paths: paths.selectExpr("path", "cast(path AS binary) AS content")

    def see(data):
        if data == b"/q.png":
            raise ValueError("blurred")
        return data.decode()

    done, texts = ingest.ocr_stage(every, texts, read, see)
    assert {r["id"]: r["ocr_status"] for r in done.where("id >= 20").collect()} == {20: "done", 21: "failed"}
    assert texts.where("file_id = 20").first()["extracted_text"] == "/p.png"
    rest = spark.createDataFrame([(30, 70), (70, 70), (100, 70), (200, 70)], "a int, t int").select(ingest.throttle_ms(F.col("a"), F.col("t")).alias("x"))
    assert [r["x"] for r in rest.collect()] == [0, 0, 60, 150]
