"""Line dedup by distinct-site spread.

Every line's sites are gathered in a HyperLogLog sketch per line hash; sketches merge by aggregation. Lines whose
estimate is clearly above the threshold are boilerplate, lines clearly below are not, and lines near it get an exact
distinct count. A boilerplate line stays in the document with the smallest doc_id that has it and goes from all others.

Defined cases: null text counts as empty; a null site is no site; lines are told apart without the white space at their
ends; lines shorter than MIN_CHARS after that are never boilerplate; a row without doc_id never counts as the first; if
no row with a line has a doc_id the line stays; repeated rows are treated alike; columns besides id, site and text pass
through whatever their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, lookup, numbered

MIN_SITES = 3
MIN_CHARS = 20
LG_K = 12
WHITE = " \t\r\f\v"
BROADCAST_BYTES = 32 << 20  # of the places of removed lines, below which texts aren't shuffled
BAND = 3 * 1.04 / 2 ** (LG_K / 2)  # three standard errors of a sketch


def _row_key(id_col: str, text_col: str):
    """Tells rows apart: id, and a hash of the text for rows that repeat an id."""
    return F.struct(F.col(id_col).cast("long").alias("d"), F.xxhash64(F.col(text_col)).alias("t"))


def lines_of(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """(row, doc, site, pos, key) of the lines long enough to be boilerplate; key is a 96-bit hash of the line."""
    flat = docs.select(_row_key(id_col, text_col).alias("row"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"))
    line = F.trim("line", F.lit(WHITE))
    return flat.where(F.length(line) >= MIN_CHARS).select("row", F.col("row.d").alias("doc"), "site", "pos", F.struct(F.xxhash64(line).alias("x"), F.crc32(line).alias("c")).alias("key"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, int]:
    """((key, first, n) of the lines on at least min_sites sites, rows of lines that repeat)."""
    sketch = F.hll_sketch_agg(F.col("site"), F.lit(LG_K))
    spread = lines.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("first"), sketch.alias("sketch")).where(F.col("n") >= min_sites)
    spread = cut(spread.withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch").where(F.col("sites") >= min_sites * (1 - BAND) - 1), "line-spread")
    total = spread.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    sure = F.col("sites") > min_sites * (1 + BAND) + 1
    near = spread.where(~sure).withColumn("near", F.lit(True))
    counted = lookup(lines.select("key", "site"), near, "key", ["near"], "n", total).where(F.col("near") & F.col("site").isNotNull())
    exact = counted.groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    found = spread.where(sure).select("key", "first", "n").unionByName(near.join(exact, "key", "left_semi").select("key", "first", "n"))
    return cut(found, "line-boilerplate"), total


def clean(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with boilerplate lines removed from text_col. counts: names of two more columns, the lines that a text had
    and those removed; docs must not have columns of these names."""
    if counts and {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {counts}")
    flat, (i, site, text) = numbered(docs, id_col, site_col, text_col)  # c0, c1, ..; names of this function's own can't clash
    lines = lines_of(flat, i, site, text)
    found, total = boilerplate(lines, min_sites)
    hits = lookup(lines.select("key", "row", "doc", "pos"), found, "key", ["first"], "n", total).where(F.col("first").isNotNull() & ~F.col("doc").eqNullSafe(F.col("first")))
    none = F.lit(-(1 << 63))
    gone = cut(hits.groupBy("row").agg(F.collect_set("pos").alias("gone")).select(F.coalesce(F.col("row.d"), none).alias("row_d"), F.col("row.t").alias("row_t"), "gone"), "line-gone")
    size = gone.agg(F.coalesce(F.sum(64 + 8 * F.size("gone")), F.lit(0))).first()[0]
    key = _row_key(i, text)
    marked = flat.withColumns({"row_d": F.coalesce(key["d"], none), "row_t": key["t"]})
    joined = marked.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone.hint("merge"), ["row_d", "row_t"], "left")
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    left = joined.withColumn("parts", F.when(F.col("gone").isNotNull(), parts))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone")), lambda k: F.get(F.col("parts"), k))
    new = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    more = [F.size(parts).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_gone")] if counts else []
    return left.select(*[new.alias(c) if c == text else F.col(c) for c in flat.columns], *more).toDF(*docs.columns, *(counts or ()))
