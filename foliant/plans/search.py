"""Search: ranked content hits, then file-name hits, filtered and merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ascii_lower
from foliant.plans import fts
from foliant.plans.index import Index
from foliant.plans.parser import ParsedQuery, QuerySyntaxError, bytes_of, filename_words, parse

COLUMNS = ["id", "path", "filename", "extension", "size", "modified_date", "is_favorite"]
SNIPPET_TOKENS = 16


def filters(q: ParsedQuery, documented: bool = True) -> Column:
    """Filters on files. Not documented: date, size and OCR are read but don't filter."""
    out = [F.lit(True)]
    if q.extension:
        out.append(F.col("extension") == q.extension)
    if q.folder:
        out.append(F.contains(ascii_lower(F.col("path")), ascii_lower(F.lit(q.folder))))
    if q.favorite:
        out.append(F.col("is_favorite"))
    if documented:
        if q.date:
            out.append(_date(q.date))
        if q.min_size and (n := bytes_of(q.min_size)) is not None:
            out.append(F.col("size") >= n)
        if q.max_size and (n := bytes_of(q.max_size)) is not None:
            out.append(F.col("size") <= n)
        if q.ocr:
            out.append(F.col("ocr_status") == "done")
    return reduce(lambda a, b: a & b, out)


def _date(value: str) -> Column:
    """YYYY or YYYY-MM-DD, as an equality or after > or <, on the UTC day of modification."""
    sign, text = (value[0], value[1:]) if value[:1] in "<>" and value else ("", value)
    day = F.date_format(F.timestamp_seconds("modified_date"), "yyyy-MM-dd")
    own = F.substring(day, 1, len(text))
    return own > text if sign == ">" else own < text if sign == "<" else own == text


def with_tag(files: DataFrame, q: ParsedQuery, tags: DataFrame | None) -> DataFrame:
    if q.tag is None:
        return files
    if tags is None:
        raise ValueError("a tag filter needs the table of tags")
    return files.join(tags.where(F.col("tag") == q.tag).select(F.col("file_id").alias("id")), "id", "left_semi")


def name_has(words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(ascii_lower(F.col("filename")), ascii_lower(F.lit(w))) for w in words], F.lit(True))


def by_filename(files: DataFrame, raw: str, limit: int = 200) -> DataFrame:
    """Files whose names have every word, newest first; without words none."""
    words = filename_words(raw)
    hits = files.where(name_has(words) if words else F.lit(False)).select(*COLUMNS)
    return hits.orderBy(F.desc("modified_date"), "id").limit(limit)


def snippet(content: Column, terms: list[str], around: int = SNIPPET_TOKENS) -> Column:
    """About ``around`` words from the first that is a query term; the head where none is."""
    words = F.filter(F.split(content, r"\s+"), lambda w: w != "")
    hit = F.array_position(F.transform(words, lambda w: F.exists(fts.tokens(w), lambda t: F.array_contains(F.array(*[F.lit(x) for x in terms] or [F.lit("")]), t))), F.lit(True)).cast("int")
    first = F.greatest(F.lit(1), hit - around // 2)
    body = F.array_join(F.slice(words, first, around), " ")
    return F.concat(F.when(first > 1, F.lit("...")).otherwise(F.lit("")), body, F.when(first + around - 1 < F.size(words), F.lit("...")).otherwise(F.lit("")))


def run_saved(searches: DataFrame, name: str, files: DataFrame, text: DataFrame, limit: int = 200, **more) -> DataFrame:
    """The hits of a saved search (search_name, search_query) by its name; an unknown name is an error."""
    row = searches.where(F.col("search_name") == name).select("search_query").first()
    if row is None:
        raise KeyError(f"no saved search named {name!r}")
    return search(files, text, row["search_query"], limit, **more)


def search(files: DataFrame, text: DataFrame, raw: str, limit: int = 200, tags: DataFrame | None = None, documented: bool = True, index: Index | None = None) -> DataFrame:
    """Hits with rank, source (0 content, 1 name) and score: content by score, then names by time; each file once.

    files: COLUMNS and ocr_status; text: file_id, extracted_text. A malformed expression leaves the name hits alone.
    """
    q = parse(raw)
    kept = with_tag(files, q, tags).where(filters(q, documented))
    words = filename_words(raw)
    named = kept.where(name_has(words)).select(*COLUMNS).orderBy(F.desc("modified_date"), "id").limit(limit).withColumns({"source": F.lit(1), "score": F.lit(0.0)})
    hits = named
    if q.has_text:
        try:
            tree = q.tree()
            if index is None:
                corpus = files.select("id", "filename").join(text.select(F.col("file_id").alias("id"), "extracted_text"), "id").withColumn("extracted_text", F.coalesce("extracted_text", F.lit("")))
                scored = fts.match(corpus, tree, ["filename", "extracted_text"]).select("id", "score")
            else:
                scored = index.match(tree)
            ranked = kept.join(scored, "id").select(*COLUMNS, F.lit(0).alias("source"), "score").orderBy("score", "id").limit(limit)
            hits = ranked.unionByName(named)
        except QuerySyntaxError:
            pass
    once = Window.partitionBy("id").orderBy("source")
    best = hits.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    order = [F.col("source"), F.when(F.col("source") == 0, F.col("score")), F.desc("modified_date"), F.col("id")]
    return best.orderBy(*order).limit(limit)
