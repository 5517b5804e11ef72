from foliant.operators import store
from foliant.sources.snapshots import Snapshots
from foliant.streaming import watch

RAW = "ts timestamp, root string, seq long, action string, path string"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r1", 1, "added", "a"), ("r1", 2, "old_name", "a"), ("r1", 3, "new_name", "b"), ("r2", 1, "new_name", "x"), ("r2", 2, "modified", "y")]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "root string, seq long, action string, path string").selectExpr("timestamp '2024-01-01' AS ts", "*").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = watch.pair_renames(watch.read_changes(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("root", "seq", "action", "path", "coalesce(new_path, '')").collect())
    want = store.pair_renames(spark.read.parquet(str(tmp_path / "in"))).selectExpr("root", "seq", "action", "path", "coalesce(new_path, '')").collect()
    assert got == sorted(tuple(r) for r in want) == [("r1", 1, "added", "a", ""), ("r1", 2, "renamed", "a", "b"), ("r2", 2, "modified", "y", "")]


def test_lonely_old_name_becomes_a_deletion(spark, tmp_path):
    """Once the watermark is past its time."""
    def put(rows):
        spark.createDataFrame(rows, "ts string, root string, seq long, action string, path string").selectExpr("timestamp(ts) AS ts", "root", "seq", "action", "path").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = watch.pair_renames(watch.read_changes(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    put([("2024-01-01 00:00:00", "r", 1, "old_name", "a")])
    put([("2024-01-01 00:05:00", "other", 1, "added", "b")])
    put([("2024-01-01 00:06:00", "other", 2, "added", "c")])
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("root", "seq", "action", "path").collect())
    assert got == [("other", 1, "added", "b"), ("other", 2, "added", "c"), ("r", 1, "deleted", "a")]


def test_debounced_stream(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:00:{s:02d}", v) for s, v in ((0, 1), (1, 2), (2, 3), (20, 4), (21, 5))] + [("z", "2024-01-01 00:10:00", 9)]
    events = spark.createDataFrame(rows, "key string, ts string, value long").selectExpr("key", "timestamp(ts) AS ts", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.debounced(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "5 seconds", "1 minute")
    q = stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r["key"], r["value"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["key"], r["value"], r["n"]) for r in store.debounce(events.where("key = 'k'"), "5 seconds").collect())
    assert got == want == [("k", 3, 3), ("k", 5, 2)]  # the newest session is still open


def test_excluded_paths(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    s.write({"files": spark.createDataFrame([("/x/a", "content_done"), ("/b", "content_done")], "path string, indexing_status string")})
    batch = spark.createDataFrame([(1, "modified", "/x/a", None), (2, "added", "/X/new", None), (3, "added", "/xy", None), (4, "deleted", "/b", None)], "seq long, action string, path string, new_path string").selectExpr("timestamp '2024-01-01' AS ts", "*")
    watch.apply_to(s, excludes=["/x"])(batch, 0)
    assert sorted(tuple(r) for r in s.read("files").collect()) == [("/x/a", "content_done"), ("/xy", "pending")]


def test_rescan(spark, tmp_path):
    import hashlib

    base = tmp_path / "docs"
    (base / "sub").mkdir(parents=True)
    (base / "sub" / "_new.txt").write_text("new")
    (base / "sub" / "old.txt").write_text("changed")
    s = Snapshots(spark, str(tmp_path / "s"))
    old = [(5, str(base / "sub" / "old.txt"), "old.txt", "txt", 3, 1, "x", "content_done")]
    s.write({"files": spark.createDataFrame(old, "id long, path string, filename string, extension string, size long, modified_date long, hash string, indexing_status string")})
    # the roots are the first two folders of each path, so the walk is kept small by excluding what is beside
    beside = [str(p) for p in tmp_path.parent.parent.iterdir() if p != tmp_path.parent] + [str(p) for p in tmp_path.parent.iterdir() if p != tmp_path]
    watch.rescan(spark, s, excludes=beside + [str(tmp_path / "s")])
    got = {r["filename"]: r for r in s.read("files").where(f"path like '{base}/%'").collect()}
    assert got["old.txt"]["id"] == 5 and got["old.txt"]["hash"] == hashlib.sha256(b"changed").hexdigest() and got["old.txt"]["indexing_status"] == "content_done"
    assert got["_new.txt"]["id"] > 5 and got["_new.txt"]["indexing_status"] == "metadata_only" and got["_new.txt"]["size"] == 3


def test_apply_once(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "s"))
    s.write({"files": spark.createDataFrame([("a", "content_done"), ("b", "content_done")], "path string, indexing_status string")})
    batch = spark.createDataFrame([(1, "renamed", "a", "n"), (2, "modified", "b", None)], "seq long, action string, path string, new_path string").selectExpr("timestamp '2024-01-01' AS ts", "*")
    handle = watch.apply_to(s)
    handle(batch, 0)
    handle(batch, 0)
    assert sorted(tuple(r) for r in s.read("files").collect()) == [("b", "pending"), ("n", "pending")]
    assert s.versions() == [2, 1]
