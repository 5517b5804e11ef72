"""Search, function and state queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.catalog import query
from foliant.functions import paths, text
from foliant.model import FILES_SQL, TAGS_SQL, changes, document_text, files, table, tags
from foliant.operators import store
from foliant.plans import index
from foliant.plans.parser import parse
from foliant.plans.search import by_filename, filters, name_has, run_saved, search, snippet, with_tag
from foliant.session import work_dir

RX = r"'[\p{L}\p{N}\p{Co}]+'"


def _tf(kind: str, terms: list[str]) -> str:
    one = {"term": f"lambda x: x = '{terms[0]}'", "prefix": f"lambda x: starts_with(x, '{terms[0]}')"}.get(kind)
    if one:
        return " + ".join(f"len(list_filter({c}, {one}))" for c in "ab")
    return " + ".join(f"len(list_filter(range(1, len({c}) + 1), lambda i: " + " AND ".join(f"{c}[i + {k}] = '{t}'" for k, t in enumerate(terms)) + "))" for c in "ab")


def fts_sql(leaves: list[tuple[str, list[str]]], matches: str, score: str, limit: int = 20) -> str:
    """Ranked search in SQL; m0.. and s0.. are the leaves' matches and scores."""
    tfs = ", ".join(f"{_tf(*x)} AS tf{k}" for k, x in enumerate(leaves))
    ns = ", ".join(f"count(*) FILTER (tf{k} > 0) AS n{k}" for k in range(len(leaves)))
    idf = lambda k: f"ln((n - n{k} + 0.5) / (n{k} + 0.5))"
    parts = ", ".join(f"tf{k} > 0 AS m{k}, CASE WHEN tf{k} > 0 THEN -(CASE WHEN {idf(k)} <= 0 THEN 1e-6 ELSE {idf(k)} END) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END AS s{k}" for k in range(len(leaves)))
    return f"""WITH {FILES_SQL}, tok AS (SELECT d.doc_id AS id, regexp_extract_all(lower(strip_accents(f.filename)), {RX}) AS a, regexp_extract_all(lower(strip_accents(d.text)), {RX}) AS b FROM documents d JOIN files f ON f.id = d.doc_id),
tf AS (SELECT id, (len(a) + len(b))::DOUBLE AS dl, {tfs} FROM tok), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {ns} FROM tf), sc AS (SELECT id, {parts} FROM tf, st)
SELECT id, round({score}, 6) AS score FROM sc WHERE {matches} ORDER BY {score}, id LIMIT {limit}"""


def corpus_index(spark, sf_dir):
    """The index of all file names and texts, written at the first query over them."""
    rows = files(spark, sf_dir).select("id", "filename").join(document_text(spark, sf_dir).withColumnRenamed("file_id", "id"), "id")
    return index.shared(spark, sf_dir, rows, "id", ["filename", "extracted_text"])


def ranked(spark, sf_dir, raw, limit=20):
    hits = corpus_index(spark, sf_dir).match(parse(raw).tree())
    return hits.orderBy("score", "id").limit(limit).select("id", F.round("score", 6).alias("score"))


def _ranked(name: str, raw: str, leaves, matches: str, score: str) -> None:
    query(fts_sql(leaves, matches, score), name)(lambda spark, sf_dir: ranked(spark, sf_dir, raw))


_ranked("search_ranked_and", "the then", [("term", ["the"]), ("term", ["then"])], "m0 AND m1", "s0 + s1")
_ranked("search_term", "idiot", [("term", ["idiot"])], "m0", "s0")
_ranked("search_or", "idiot OR clown then", [("term", ["idiot"]), ("term", ["clown"]), ("term", ["then"])], "m0 OR (m1 AND m2)", "(CASE WHEN m0 THEN s0 ELSE 0 END + CASE WHEN m1 AND m2 THEN s1 + s2 ELSE 0 END)")
_ranked("search_not", "thinor -the idiot", [("term", ["thinor"]), ("term", ["the"]), ("term", ["idiot"])], "m0 AND NOT (m1 AND m2)", "s0")
_ranked("search_phrase", '"and the"', [("phrase", ["and", "the"])], "m0", "s0")
_ranked("search_prefix", "worth*", [("prefix", ["worth"])], "m0", "s0")
_ranked("search_accents", "ÉTÉ OR éle", [("term", ["ete"]), ("term", ["ele"])], "m0 OR m1", "(s0 + s1)")

CUT = "id, path, filename, extension, size, modified_date, is_favorite"


def _filtered(spark, sf_dir, raw, documented=True):
    q = parse(raw)
    return with_tag(files(spark, sf_dir), q, tags(spark, sf_dir)).where(filters(q, documented)).where(name_has([])).select(*CUT.split(", "))


def _filter(name: str, raw: str, where: str, documented: bool = True) -> None:
    query(f"WITH {FILES_SQL}, {TAGS_SQL} SELECT {CUT} FROM files WHERE {where}", name)(lambda spark, sf_dir: _filtered(spark, sf_dir, raw, documented))


_filter("search_filtered_type_folder", "type:PDF folder:SRC1", "extension = 'pdf' AND contains(lower(path), 'src1')")
_filter("search_tag_semi", "tag:toxic", "id IN (SELECT file_id FROM tags WHERE tag = 'toxic')")
_filter("favorite_filter", "favorite:1", "is_favorite")
_filter("date_filter", "date:2024", "strftime(make_timestamp(modified_date * 1000000), '%Y') = '2024'")
_filter("date_after_filter", "date:>2024-02-15 type:md", "strftime(make_timestamp(modified_date * 1000000), '%Y-%m-%d') > '2024-02-15' AND extension = 'md'")
_filter("size_filter", "size:1KB-4KB", "size BETWEEN 1024 AND 4096")
_filter("ocr_filter", "ocr:1", "ocr_status = 'done'")
_filter("strict_mode_filter", "date:2024 size:>1MB ext:txt", "extension = 'txt'", documented=False)


@query(f"WITH {FILES_SQL} SELECT {CUT} FROM files WHERE contains(lower(filename), 'src1') AND contains(lower(filename), 'pdf') ORDER BY modified_date DESC, id LIMIT 50")
def filename_search(spark, sf_dir):
    return by_filename(files(spark, sf_dir), "SRC1+pdf", 50)


_MERGE = fts_sql([("term", ["pdf"]), ("term", ["the"])], "m0 AND m1", "s0 + s1", 25)


@query(f"WITH c AS ({_MERGE}), {FILES_SQL}, n AS (SELECT id FROM files WHERE contains(lower(filename), 'pdf') AND contains(lower(filename), 'the') ORDER BY modified_date DESC, id LIMIT 25) SELECT id, source, score FROM (SELECT id, 0 AS source, score FROM c UNION ALL SELECT id, 1, 0.0 FROM n WHERE id NOT IN (SELECT id FROM c)) ORDER BY source, score, id LIMIT 25")
def search_merge_filename_content(spark, sf_dir):
    return search(files(spark, sf_dir), document_text(spark, sf_dir), "pdf the", 25, index=corpus_index(spark, sf_dir)).select("id", "source", F.round("score", 6).alias("score"))


@query(f"WITH {FILES_SQL} SELECT id, 1 AS source, 0.0::DOUBLE AS score FROM files WHERE contains(lower(filename), 'a.b*') ORDER BY modified_date DESC, id LIMIT 25")
def search_malformed_falls_back(spark, sf_dir):
    return search(files(spark, sf_dir), document_text(spark, sf_dir), "a.b*", 25).select("id", "source", "score")


@query(f"""WITH h AS ({fts_sql([("term", ["idiot"])], "m0", "s0")}), w AS (SELECT id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM h JOIN documents ON doc_id = id),
p AS (SELECT id, w, greatest(1, coalesce(list_position(list_transform(w, lambda x: list_contains(regexp_extract_all(lower(strip_accents(x)), {RX}), 'idiot')), true), 0) - 8) AS f FROM w)
SELECT id, CASE WHEN f > 1 THEN '...' ELSE '' END || array_to_string(w[f:f + 15], ' ') || CASE WHEN f + 15 < len(w) THEN '...' ELSE '' END AS snippet FROM p""")
def snippet_fts(spark, sf_dir):
    hits = ranked(spark, sf_dir, "idiot")
    return hits.join(document_text(spark, sf_dir).withColumnRenamed("file_id", "id"), "id").select("id", snippet(F.col("extracted_text"), ["idiot"]).alias("snippet"))


@query(f"WITH c AS ({_MERGE}), {FILES_SQL}, n AS (SELECT id FROM files WHERE contains(lower(filename), 'pdf') AND contains(lower(filename), 'the') ORDER BY modified_date DESC, id LIMIT 25) SELECT id, source FROM (SELECT id, 0 AS source, score FROM c UNION ALL SELECT id, 1, 0.0 FROM n WHERE id NOT IN (SELECT id FROM c)) ORDER BY source, score, id LIMIT 25")
def saved_search_run(spark, sf_dir):
    saved = spark.createDataFrame([(1, "other", "idiot", 0), (2, "papers", "pdf the", 0)], "id long, search_name string, search_query string, created_at long")
    return run_saved(saved, "papers", files(spark, sf_dir), document_text(spark, sf_dir), 25, index=corpus_index(spark, sf_dir)).select("id", "source")


_CHANGED = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'then ' || text ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id % 5 <> 0"


@query(fts_sql([("term", ["the"]), ("term", ["then"])], "m0 AND m1", "s0 + s1").replace("FROM documents d JOIN files", f"FROM ({_CHANGED}) d JOIN files"))
def index_update(spark, sf_dir):
    """The first query again, after texts changed and files went."""
    rows = files(spark, sf_dir).select("id", "filename").join(document_text(spark, sf_dir).withColumnRenamed("file_id", "id"), "id")
    own = index.Index.build(rows, f"{work_dir(spark)}/foliant/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}", "id", ["filename", "extracted_text"])
    own.update(rows.where("id % 2 = 0").withColumn("extracted_text", F.concat(F.lit("then "), "extracted_text")), "id", rows.where("id % 5 = 0 and id % 2 = 1").select("id"))
    own.delete(rows.where("id % 10 = 0").select("id"))
    hits = own.match(parse("the then").tree())
    return hits.orderBy("score", "id").limit(20).select("id", F.round("score", 6).alias("score"))


@query('SELECT event_type AS query, max(ts) AS "at" FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20')
def recent_searches(spark, sf_dir):
    return store.recent_searches(table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("ts").alias("at")))


# scalar functions
DOC = "documents"


@query("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents")
def ascii_lower(spark, sf_dir):
    return table(spark, sf_dir, DOC).select("doc_id", text.ascii_lower(F.col("text")).alias("lowered"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[ \t\n\r\f\v]+', ' ', 'g')) AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, DOC).select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, DOC).select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("""WITH p AS (SELECT doc_id, text, instr(lower(text), 'idiot')::INTEGER AS hit FROM documents), q AS (SELECT *, greatest(1, hit - 80) AS b, least(length(text), hit + 4 + 120) AS e FROM p)
SELECT doc_id, CASE WHEN hit > 0 THEN (CASE WHEN b > 1 THEN '...' ELSE '' END) || substring(text, b, e - b + 1) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) ELSE substring(text, 1, 200) END AS snippet FROM q""")
def snippet_around(spark, sf_dir):
    return table(spark, sf_dir, DOC).select("doc_id", text.snippet_around(F.col("text"), "idiot").alias("snippet"))


@query(r"SELECT page_id, regexp_replace(html, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS clean, '\"' || replace(url, '\"', '\"\"') || '\"' AS quoted FROM pages".replace(r'\"', '"'))
def strip_control(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_control(F.col("html")).alias("clean"), text.quote_phrase(F.col("url")).alias("quoted"))


_SIZE = "CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0::DOUBLE) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0::DOUBLE) || ' MB' WHEN n < 1099511627776 THEN printf('%.1f', n / 1073741824.0::DOUBLE) || ' GB' ELSE printf('%.1f', n / 1099511627776.0::DOUBLE) || ' TB' END"


@query(f"SELECT doc_id, n, {_SIZE} AS label FROM (SELECT doc_id, (n_chars * n_chars * 37 + 1)::BIGINT AS n FROM documents)")
def format_size(spark, sf_dir):
    d = table(spark, sf_dir, DOC).select("doc_id", (F.col("n_chars") * F.col("n_chars") * 37 + 1).alias("n"))
    return d.select("doc_id", "n", text.format_size(F.col("n")).alias("label"))


@query("SELECT p_partkey, levenshtein(lower(p_name), lower(p_type))::INTEGER AS distance FROM part")
def levenshtein_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.levenshtein(F.col("p_name"), F.col("p_type")).alias("distance"))


@query(r"""WITH w AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9_]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9_]+'), lambda x: x <> '')) AS b FROM part)
SELECT p_partkey, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END::DOUBLE AS similarity FROM w""")
def jaccard_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.jaccard(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query("SELECT doc_id, sha256(text) AS hash, left(text, 64) AS head FROM documents")
def sha256_text(spark, sf_dir):
    return table(spark, sf_dir, DOC).select("doc_id", F.sha2("text", 256).alias("hash"), F.substring("text", 1, 64).alias("head"))


@query(r"SELECT page_id, lower(regexp_extract(url, '\.([^./\\]*)$', 1)) AS extension FROM pages")
def extension_of(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.extension_of(F.col("url")).alias("extension"))


@query(f"WITH {FILES_SQL} SELECT DISTINCT '/corpus/' || split_part(path, '/', 3) AS folder FROM files")
def top2_folders(spark, sf_dir):
    return files(spark, sf_dir).select(paths.top_two(F.col("path")).alias("folder")).distinct()


@query(f"WITH {FILES_SQL} SELECT id, path FROM files WHERE starts_with(lower(path) || '/', '/corpus/en/src1/') OR starts_with(lower(path) || '/', '/corpus/fr/')")
def path_under_any(spark, sf_dir):
    return files(spark, sf_dir).where(paths.is_under_any(F.col("path"), ["\\Corpus\\EN\\src1", "/corpus/fr/"])).select("id", "path")


@query(f"WITH {FILES_SQL}, d AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'ZIP' ELSE extension END AS e, date_diff('day', make_timestamp(modified_date * 1000000)::DATE, DATE '2025-06-30') AS age FROM files) SELECT id, (CASE WHEN lower(e) IN ('zip','rar','7z','tar','gz','bz2') THEN 4 WHEN age <= 30 THEN 1 WHEN age <= 365 THEN 2 ELSE 3 END)::INTEGER AS band FROM d")
def priority_bands(spark, sf_dir):
    ext = F.when(F.col("id") % 13 == 0, "ZIP").otherwise(F.col("extension"))
    return files(spark, sf_dir).select("id", paths.priority(ext, F.timestamp_seconds("modified_date").cast("date"), F.lit("2025-06-30").cast("date")).alias("band"))


@query(f"WITH {FILES_SQL} SELECT id, make_timestamp(modified_date * 1000000) AS at FROM files")
def filetime_to_timestamp(spark, sf_dir):
    ticks = F.col("modified_date") * 10000000 + F.lit(paths.EPOCH_TICKS)
    return files(spark, sf_dir).select("id", paths.filetime(ticks).cast("timestamp_ntz").alias("at"))


@query(f"WITH {FILES_SQL} SELECT id, md5(path || '|' || modified_date || '|' || size) AS cache_key, CASE indexing_status WHEN 'pending' THEN 'Pending' WHEN 'metadata_only' THEN 'Metadata only' WHEN 'content_done' THEN 'Content indexed' ELSE 'Failed' END AS label FROM files")
def cache_key_and_label(spark, sf_dir):
    return files(spark, sf_dir).select("id", paths.cache_key(F.col("path"), F.col("modified_date"), F.col("size")).alias("cache_key"), paths.status_label(F.col("indexing_status")).alias("label"))


@query("SELECT doc_id, (doc_id % 5 = 0) OR (trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END) = '' AND doc_id % 2 = 0) AS needs_ocr FROM documents")
def ocr_need_rule(spark, sf_dir):
    d = table(spark, sf_dir, DOC)
    own = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text"))
    ext = F.when(F.col("doc_id") % 2 == 0, "PNG").otherwise("txt")
    return d.select("doc_id", paths.needs_ocr(F.col("doc_id") % 5 == 0, own, ext).alias("needs_ocr"))


@query(f"WITH {FILES_SQL} SELECT id, CASE WHEN extension IN ('pdf','doc','docx','xls','xlsx','ppt','pptx','txt','rtf','csv','md') THEN 'pending' ELSE 'not_needed' END AS ocr_status FROM files")
def scan_ocr_status(spark, sf_dir):
    return files(spark, sf_dir).select("id", paths.initial_ocr_status(F.col("extension")).alias("ocr_status"))


@query(f"WITH {FILES_SQL} SELECT filename, path, extension, size, strftime(make_timestamp(modified_date * 1000000), '%Y-%m-%dT%H:%M:%S') AS modified_date FROM files WHERE extension = 'pdf' ORDER BY files.modified_date DESC, id LIMIT 10000")
def csv_export_projection(spark, sf_dir):
    f = files(spark, sf_dir).where("extension = 'pdf'").orderBy(F.desc("modified_date"), "id").limit(10000)
    return f.select("filename", "path", "extension", "size", F.date_format(F.timestamp_seconds("modified_date"), "yyyy-MM-dd'T'HH:mm:ss").alias("modified_date"))


@query(f"WITH {FILES_SQL} SELECT id, upper(extension) AS kind, strftime(make_timestamp(modified_date * 1000000), '%Y-%m-%d') AS day, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS snippet FROM files JOIN documents ON doc_id = id")
def result_rows(spark, sf_dir):
    f = files(spark, sf_dir).join(document_text(spark, sf_dir).withColumnRenamed("file_id", "id"), "id")
    return f.select("id", F.upper("extension").alias("kind"), F.date_format(F.timestamp_seconds("modified_date"), "yyyy-MM-dd").alias("day"), text.clip(text.strip_bold(F.col("extracted_text"))).alias("snippet"))


# state
_NEW = "SELECT path, filename, extension, CASE WHEN id % 3 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN id % 4 = 0 THEN modified_date + 60 ELSE modified_date - 60 END AS modified_date, 'new' AS hash FROM files WHERE id % 2 = 0 UNION ALL SELECT path || '.new', filename, extension, size, modified_date, 'new' FROM files WHERE id % 50 = 1"


@query(f"WITH {FILES_SQL}, nw AS ({_NEW}) SELECT coalesce(f.path, nw.path) AS path, CASE WHEN f.id IS NULL THEN 'inserted' WHEN f.modified_date < nw.modified_date OR f.size <> nw.size THEN 'updated' ELSE 'kept' END AS change, CASE WHEN f.id IS NULL OR f.modified_date < nw.modified_date OR f.size <> nw.size THEN nw.hash ELSE f.hash END AS hash, f.indexing_status FROM files f FULL JOIN nw ON f.path = nw.path")
def upsert_guarded(spark, sf_dir):
    f = files(spark, sf_dir)
    even = f.where("id % 2 = 0").select("path", "filename", "extension", F.when(F.col("id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("id") % 4 == 0, F.col("modified_date") + 60).otherwise(F.col("modified_date") - 60).alias("modified_date"), F.lit("new").alias("hash"))
    more = f.where("id % 50 = 1").select(F.concat("path", F.lit(".new")).alias("path"), "filename", "extension", "size", "modified_date", F.lit("new").alias("hash"))
    return store.upsert(f, even.unionByName(more)).select("path", "change", "hash", "indexing_status")


@query(f"WITH {FILES_SQL}, {TAGS_SQL} SELECT (SELECT count(*) FROM files WHERE id % 5 <> 0) AS n_files, (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0) AS n_texts, (SELECT count(*) FROM tags WHERE file_id % 5 <> 0) AS n_tags")
def delete_cascade(spark, sf_dir):
    f = files(spark, sf_dir)
    left = store.delete(f.where("id % 5 = 0").select("id"), f, text=document_text(spark, sf_dir), tags=tags(spark, sf_dir))
    count = lambda t, name: left[t].agg(F.count("*").alias(name))
    return count("files", "n_files").crossJoin(count("text", "n_texts")).crossJoin(count("tags", "n_tags"))


@query(f"WITH {FILES_SQL} SELECT id, path FROM files WHERE id % 4 <> 3")
def prune_deleted(spark, sf_dir):
    f = files(spark, sf_dir)
    return store.prune(f, f.where("id % 4 <> 3")).select("id", "path")


@query(f"WITH {FILES_SQL} SELECT id, length(coalesce(CASE WHEN id % 9 <> 0 THEN text END, ''))::INTEGER AS n_chars FROM files JOIN documents ON id = doc_id")
def reindex_left_join(spark, sf_dir):
    known = document_text(spark, sf_dir).where("file_id % 9 <> 0").withColumnRenamed("file_id", "id")
    return files(spark, sf_dir).select("id").join(known, "id", "left").select("id", F.length(F.coalesce("extracted_text", F.lit(""))).alias("n_chars"))


@query("SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN 'new text' ELSE text END AS extracted_text FROM documents")
def replace_text(spark, sf_dir):
    t = document_text(spark, sf_dir)
    return store.replace_text(t, t.where("file_id % 2 = 0").select("file_id", F.lit("new text").alias("extracted_text")))


@query(f"WITH {FILES_SQL} SELECT id, extension FROM files WHERE indexing_status <> 'content_done'")
def todo_extract(spark, sf_dir):
    return store.todo(files(spark, sf_dir)).select("id", "extension")


@query(f"WITH {FILES_SQL} SELECT id, path FROM files WHERE indexing_status IN ('pending', 'metadata_only') ORDER BY modified_date DESC, id LIMIT 1")
def pending_queue(spark, sf_dir):
    return store.pending(files(spark, sf_dir)).select("id", "path")


@query(f"WITH {FILES_SQL}, {TAGS_SQL} SELECT count(*) AS total, count(*) FILTER (indexing_status = 'content_done') AS content_done, count(*) FILTER (indexing_status = 'metadata_only') AS metadata_only, count(*) FILTER (indexing_status = 'failed') AS failed, (SELECT count(DISTINCT file_id) FROM tags) AS tagged, 0::BIGINT AS saved_searches FROM files")
def index_stats(spark, sf_dir):
    return store.statistics(files(spark, sf_dir), tags(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT count(*) AS scanned, count(*) FILTER (indexing_status = 'content_done') AS indexed, count(*) FILTER (ocr_status = 'done') AS ocr, count(*) FILTER (indexing_status IN ('pending','metadata_only')) AS waiting, count(*) FILTER (indexing_status = 'failed') AS errors FROM files")
def progress_counters(spark, sf_dir):
    return store.progress(files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT indexing_status, count(*) AS n FROM files GROUP BY 1")
def count_by_status(spark, sf_dir):
    return files(spark, sf_dir).groupBy("indexing_status").agg(F.count("*").alias("n"))


@query(f"WITH {TAGS_SQL} SELECT file_id, array_to_string(list_sort(list(tag)), ',') AS tags FROM tags GROUP BY 1")
def tags_by_file(spark, sf_dir):
    return store.tags_by_file(tags(spark, sf_dir)).select("file_id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {FILES_SQL}, {TAGS_SQL}, g AS (SELECT file_id, array_to_string(list_sort(list(tag)), ',') AS tags FROM tags GROUP BY 1), m AS (SELECT conv_id, arg_max(text, turn) AS note FROM conversations GROUP BY 1) SELECT id, path, coalesce(g.tags, '') AS tags, coalesce(note, '') AS note FROM files LEFT JOIN g ON g.file_id = id LEFT JOIN m ON conv_id = id WHERE id = 28 OR path LIKE '%\\_35.csv' ESCAPE '\\'")
def point_lookup(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.max_by("text", "turn").alias("note"))
    one = files(spark, sf_dir).where((F.col("id") == 28) | F.endswith("path", F.lit("_35.csv")))
    return store.record(one, tags(spark, sf_dir), notes).select("id", "path", F.array_join("tags", ",").alias("tags"), "note")


@query("WITH g AS (SELECT sha256(text) AS hash, count(*) AS n, list_sort(list(doc_id)) AS l FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT hash, n, array_to_string(l, ',') AS ids FROM g")
def duplicates_by_hash(spark, sf_dir):
    return store.duplicate_ids(files(spark, sf_dir)).select("hash", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {FILES_SQL}, g AS (SELECT hash, count(*) AS n FROM files GROUP BY 1 HAVING count(*) > 1) SELECT id, path, hash, n FROM files JOIN g USING (hash)")
def duplicates_expanded(spark, sf_dir):
    return store.duplicates_expanded(files(spark, sf_dir)).select("id", "path", "hash", "n")


@query("SELECT user_id AS id, count(*) AS open_count, max(ts) AS last_opened FROM events WHERE event_type = 'view' GROUP BY 1")
def open_counts(spark, sf_dir):
    return store.open_counts(table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("id"), "ts"))


_RAW = "SELECT user_id AS root, event_id AS seq, CASE event_type WHEN 'signup' THEN 'added' WHEN 'click' THEN 'modified' WHEN 'purchase' THEN 'old_name' WHEN 'error' THEN 'new_name' ELSE 'deleted' END AS action, 'p' || event_id AS path FROM events"


@query(f"WITH r AS ({_RAW}), s AS (SELECT *, lead(path) OVER w AS nx, lag(action) OVER w AS pv FROM r WINDOW w AS (PARTITION BY root ORDER BY seq)) SELECT root, seq, CASE WHEN action = 'old_name' THEN CASE WHEN nx IS NULL THEN 'deleted' ELSE 'renamed' END ELSE action END AS action, path, CASE WHEN action = 'old_name' THEN nx END AS new_path FROM s WHERE action <> 'new_name' AND (pv IS NULL OR pv <> 'old_name')")
def rename_pairing(spark, sf_dir):
    kind = F.col("event_type")
    raw = table(spark, sf_dir, "events").select(F.col("user_id").alias("root"), F.col("event_id").alias("seq"), F.when(kind == "signup", "added").when(kind == "click", "modified").when(kind == "purchase", "old_name").when(kind == "error", "new_name").otherwise("deleted").alias("action"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"))
    return store.pair_renames(raw)


@query("WITH c AS (SELECT '/u/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'added' WHEN 'click' THEN 'modified' WHEN 'purchase' THEN 'renamed' WHEN 'error' THEN 'deleted' END AS action, ts, event_id FROM events WHERE event_type <> 'view') SELECT path, arg_max(action, (ts, event_id)) AS action, count(*) AS n_changes, max(ts) AS last_ts FROM c GROUP BY 1")
def change_fold(spark, sf_dir):
    return store.fold_changes(changes(spark, sf_dir))


@query("WITH e AS (SELECT user_id AS key, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts) AS run FROM e) SELECT key, arg_max(event_id, ts) AS value, count(*) AS n, max(ts) AS ts FROM s GROUP BY key, run")
def debounce_sessions(spark, sf_dir):
    return store.debounce(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("value")), "6 hours")
