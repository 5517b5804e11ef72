"""State changes as functions from tables to tables, and summaries of the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.paths import DOCUMENTS

KEPT = ["size", "modified_date", "hash", "filename", "extension"]


def upsert(files: DataFrame, new: DataFrame, columns: list[str] = KEPT) -> DataFrame:
    """files after new records by path: a stored row changes only if the new one is later or of another size.

    Of new records with one path the latest counts, of equals the one greatest in its other columns. Inserted rows have
    no id yet; ``number_new`` gives them one.
    """
    order = [F.col("modified_date"), *[F.col(c) for c in columns if c != "modified_date"]]
    last = new.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_new"))
    fresh = last.select("path", *[F.col(f"_new.{c}").alias(f"_n_{c}") for c in columns])
    both = files.join(fresh, "path", "full_outer")
    stored = F.col("id").isNotNull()
    changed = stored & ((F.col("modified_date") < F.col("_n_modified_date")) | (F.col("size") != F.col("_n_size")))
    out = both.withColumns({c: F.when(~stored | changed, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in columns} | {"change": F.when(~stored, "inserted").when(changed, "updated").otherwise("kept")})
    return out.drop(*[f"_n_{c}" for c in columns])


BUCKETS = 4096


def number_new(upserted: DataFrame) -> DataFrame:
    """Ids for inserted rows: after the largest, by hash bucket of the path and the path in it.

    A row's bucket depends on its path alone, so a task that is run again numbers alike; each bucket is ordered for itself.
    """
    top = upserted.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = upserted.where("id is null").withColumn("_p", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))
    before = fresh.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")  # at most BUCKETS rows
    ranked = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("path")))
    numbered = ranked.join(F.broadcast(before), "_p").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_b") + F.col("_r")).drop("_p", "_r", "_b", "_top")
    return upserted.where("id is not null").unionByName(numbered)


def replace_text(text: DataFrame, new: DataFrame) -> DataFrame:
    return text.join(new.select("file_id"), "file_id", "left_anti").unionByName(new)


def set_status(files: DataFrame, ids: DataFrame, indexing: str | None = None, ocr: str | None = None) -> DataFrame:
    if not indexing and not ocr:
        raise ValueError("no status to set")
    mark = files.join(ids.select("id", F.lit(True).alias("_m")).distinct(), "id", "left")
    for column, value in (("indexing_status", indexing), ("ocr_status", ocr)):
        if value:
            mark = mark.withColumn(column, F.when(F.col("_m"), value).otherwise(F.col(column)))
    return mark.drop("_m")


def delete(gone: DataFrame, files: DataFrame, **dependents: DataFrame) -> dict[str, DataFrame]:
    """files and the tables that hang on them by file_id, without the ids in gone."""
    out = {"files": files.join(gone.select("id"), "id", "left_anti")}
    return out | {k: t.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti") for k, t in dependents.items()}


def prune(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Files that a scan still finds."""
    return files.join(scan.select("path"), "path", "left_semi")


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    trimmed = new.select("file_id", F.trim("tag").alias("tag")).where("tag <> ''")
    return tags.select("file_id", "tag").unionByName(trimmed).dropDuplicates(["file_id", "tag"])


def remove_tag(tags: DataFrame, file_id: int, tag: str) -> DataFrame:
    return tags.where(~((F.col("file_id") == file_id) & (F.col("tag") == tag)))


def tags_by_file(tags: DataFrame) -> DataFrame:
    return tags.groupBy("file_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))


def set_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    return notes.join(new.select("file_id"), "file_id", "left_anti").unionByName(new)


def record(files: DataFrame, tags: DataFrame, notes: DataFrame) -> DataFrame:
    """Files with their tags and note."""
    return files.join(tags_by_file(tags), files["id"] == F.col("file_id"), "left").drop("file_id").join(notes.select(F.col("file_id").alias("id"), "note"), "id", "left").withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "note": F.coalesce("note", F.lit(""))})


def set_favorite(files: DataFrame, ids: DataFrame, favorite: bool = True) -> DataFrame:
    """files with the flag of the given ids (id) set or taken away."""
    marked = files.join(ids.select("id", F.lit(True).alias("_m")).distinct(), "id", "left")
    return marked.withColumn("is_favorite", F.when(F.col("_m"), F.lit(favorite)).otherwise(F.col("is_favorite"))).drop("_m")


def set_content(files: DataFrame, text: DataFrame, new: DataFrame, indexing: str = "", ocr: str = "", index=None, names: str = "filename") -> tuple[DataFrame, DataFrame]:
    """(files, text) with new texts (file_id, extracted_text) and the statuses given; an index gets the rows anew."""
    ids = new.select(F.col("file_id").alias("id"))
    done = set_status(files, ids, indexing, ocr) if indexing or ocr else files
    if index is not None:
        rows = files.select("id", names).join(new.select(F.col("file_id").alias("id"), "extracted_text"), "id")
        index.update(rows.select("id", *index.columns), "id")
    return done, replace_text(text, new)


def open_counts(opens: DataFrame) -> DataFrame:
    """(id, open_count, last_opened) from open events (id, ts)."""
    return opens.groupBy("id").agg(F.count("*").alias("open_count"), F.max("ts").alias("last_opened"))


def save_search(searches: DataFrame, name: str, query: str, now: int) -> DataFrame:
    """Upserts by name; an existing row keeps its id and time."""
    spark = searches.sparkSession
    old = searches.where(F.col("search_name") == name)
    if old.isEmpty():
        top = searches.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
        return searches.unionByName(spark.createDataFrame([(top + 1, name, query, now)], searches.schema))
    return searches.withColumn("search_query", F.when(F.col("search_name") == name, query).otherwise(F.col("search_query")))


def rename_search(searches: DataFrame, old: str, new: str) -> DataFrame:
    if not searches.where(F.col("search_name") == new).isEmpty():
        raise ValueError(f"a search named {new!r} exists")
    return searches.withColumn("search_name", F.when(F.col("search_name") == old, new).otherwise(F.col("search_name")))


def delete_search(searches: DataFrame, name: str) -> DataFrame:
    return searches.where(F.col("search_name") != name)


def recent_searches(log: DataFrame, most: int = 50, shown: int = 20) -> DataFrame:
    """The last distinct searches, newest first, from a log (query, at)."""
    last = log.select(F.trim("query").alias("query"), "at").where("query <> ''").groupBy("query").agg(F.max("at").alias("at"))
    return last.orderBy(F.desc("at"), "query").limit(min(most, shown))


def todo(files: DataFrame) -> DataFrame:
    """Files to extract; read them in order of id (``orderBy``) where the order matters."""
    return files.where((F.col("indexing_status") != "content_done") & F.col("extension").isin(*DOCUMENTS, "log"))


def pending(files: DataFrame, n: int = 1) -> DataFrame:
    return files.where(F.col("indexing_status").isin("pending", "metadata_only")).orderBy(F.desc("modified_date"), "id").limit(n)


def statistics(files: DataFrame, tags: DataFrame, searches: int = 0) -> DataFrame:
    """One row of counts."""
    status = F.col("indexing_status")
    counts = files.agg(F.count("*").alias("total"), *[F.count_if(status == s).alias(s) for s in ("content_done", "metadata_only", "failed")])
    return counts.crossJoin(tags.agg(F.countDistinct("file_id").alias("tagged"))).withColumn("saved_searches", F.lit(searches).cast("long"))


def progress(files: DataFrame) -> DataFrame:
    """Scanned, indexed, OCR done, waiting and failed files in one row."""
    status, ocr = F.col("indexing_status"), F.col("ocr_status")
    return files.agg(F.count("*").alias("scanned"), F.count_if(status == "content_done").alias("indexed"), F.count_if(ocr == "done").alias("ocr"), F.count_if(status.isin("pending", "metadata_only")).alias("waiting"), F.count_if(status == "failed").alias("errors"))


def duplicates(files: DataFrame) -> DataFrame:
    """(hash, n, first) of contents that several files have; first is the smallest id. No group is held in a list."""
    return files.where("hash <> ''").groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


def duplicates_expanded(files: DataFrame) -> DataFrame:
    """Every file of a duplicate group with the group's size and smallest id; groups are counted before files join."""
    return files.join(duplicates(files), "hash")


def duplicate_ids(files: DataFrame, most: int = 10_000) -> DataFrame:
    """(hash, n, ids) with ids in order, for groups of at most ``most`` files, whose lists fit in a row; larger groups
    have null ids and are listed by ``duplicates_expanded``."""
    small = duplicates_expanded(files).where(F.col("n") <= most).groupBy("hash").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return duplicates(files).select("hash", "n").join(small, "hash", "left")


def pair_renames(records: DataFrame) -> DataFrame:
    """Changes from raw records (root, seq, action, path): an old name and the record after it are a rename."""
    w = Window.partitionBy("root").orderBy("seq")
    seen = records.withColumns({"_next": F.lead("path").over(w), "_before": F.lag("action").over(w)})
    kept = seen.where((F.col("action") != "new_name") & ((F.col("_before") != "old_name") | F.col("_before").isNull()))
    renamed = (F.col("action") == "old_name") & F.col("_next").isNotNull()
    return kept.select("root", "seq", F.when(renamed, "renamed").when(F.col("action") == "old_name", "deleted").otherwise(F.col("action")).alias("action"), "path", F.when(renamed, F.col("_next")).alias("new_path"))


def fold_changes(changes: DataFrame) -> DataFrame:
    """The last action of each path, from changes (ts, seq, action, path)."""
    return changes.groupBy("path").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"), F.count("*").alias("n_changes"), F.max("ts").alias("last_ts"))


def apply_changes(files: DataFrame, folded: DataFrame) -> DataFrame:
    """files after folded changes: deleted and renamed-away paths go, others are to be indexed anew."""
    gone = folded.where(F.col("action").isin("deleted", "renamed")).select("path")
    again = folded.where(F.col("action").isin("added", "modified")).select("path", F.lit(True).alias("_again"))
    left = files.join(gone, "path", "left_anti").join(again, "path", "full_outer")
    return left.withColumn("indexing_status", F.when(F.col("_again"), "pending").otherwise(F.col("indexing_status"))).drop("_again")


def debounce(events: DataFrame, gap: str = "150 milliseconds") -> DataFrame:
    """The last event of each run of a key's events (key, ts, value) with no gap as long as that."""
    return events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.max_by("value", "ts").alias("value"), F.count("*").alias("n"), F.max("ts").alias("ts")).drop("w")
