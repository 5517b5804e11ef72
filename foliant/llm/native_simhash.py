"""Native SimHash document fingerprints, with permuted block tables.

Everything is DataFrame functions. A text's terms are its pairs of neighbouring words, lower-cased; each occurrence votes
with its 64-bit hash, so a term weighs as much as it occurs. Votes for two bits share one long counter (32 bits each), and
32 sums over the exploded hashes give all 64 counts with map-side combining.

The tables: 64 bits are cut into blocks, radius+1 of them or more as fingerprints are many; each table brings another
choice of all but radius blocks to the front as its key, so fingerprints within the radius meet under some key. A pair is
reported by the first table that it shares.

Defined cases: null text counts as empty; a text without words has fingerprint zero; null ids sort first, as the least
long; rows that repeat id and text follow one another; after the last document comes the first; one document alone is
its own next; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import cut, pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RADIUS = 3
SALT = 8
_PAIR = 0x0000000100000001


def _words(text: str) -> Column:
    return F.filter(F.split(F.translate(F.col(text), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _terms(words: str) -> Column:
    """array<long>: hashes of neighbouring word pairs; the last word stands alone."""
    return F.zip_with(F.col(words), F.slice(F.col(words), F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def _votes(h: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(F.col(h), k).bitwiseAND(F.lit(_PAIR))).alias(f"s{k}") for k in range(32)]


def _majority(total: Column) -> Column:
    """The fingerprint as a long from the 32 double counters and the number of votes."""
    out = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"s{k}"), 32)
        one = 1 << (k + 32)
        for count, bit in ((low, 1 << k), (high, one - (1 << 64) if k == 31 else one)):
            out = out.bitwiseOR(F.when(2 * count > total, F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return out


def to_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs, text = pick(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, n, copies, fp) of the distinct rows (d: id, t: hash of the text), n its code points."""
    rows = _base(docs, id_col, text_col).select("d", "t", F.length("text").cast("long").alias("n"), _words("text").alias("words")).select("d", "t", "n", F.posexplode_outer(_terms("words")).alias("pos", "h"))
    first = F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.lit(1)).otherwise(F.lit(0)))
    sums = rows.groupBy("d", "t").agg(F.max("n").alias("n"), first.alias("copies"), F.count("h").alias("w"), *_votes("h"))
    return cut(sums.select("d", "t", "n", "copies", F.coalesce(_majority(F.col("w")), F.lit(0)).alias("fp")), "native-simhash")


def followed(prints: DataFrame) -> DataFrame:
    """prints with next_d, next_t, next_fp: the next distinct row in ascending (d, t), the first after the last."""
    parts = max(1, min(prints.rdd.getNumPartitions() * 4, 4 * prints.sparkSession.sparkContext.defaultParallelism))
    dealt = cut(prints.repartitionByRange(parts, "d", "t").withColumn("bucket", F.spark_partition_id()), "native-order")
    inside = Window.partitionBy("bucket").orderBy("d", "t")
    here = F.struct("d", "t", "fp")
    heads = dealt.groupBy("bucket").agg(F.min(here).alias("head"))  # one row a bucket
    across = Window.orderBy("bucket")
    after = heads.select("bucket", F.coalesce(F.lead("head").over(across), F.min("head").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    led = dealt.withColumn("next", F.lead(here).over(inside)).join(F.broadcast(after), "bucket")
    then = F.coalesce("next", "after")
    return cut(led.select("d", "t", "n", "copies", "fp", then["d"].alias("next_d"), then["t"].alias("next_t"), then["fp"].alias("next_fp")), "native-next")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_texts).

    near_texts: how many distinct fingerprints are within RADIUS of the row's own, itself included, for the stated query
    set of ids divisible by 20; null for the others.
    """
    prints = fingerprints(docs, id_col, text_col)
    led = followed(prints)
    again = led.where("copies > 1").select("d", "t", "n", F.explode(F.array_repeat(F.lit(1), (F.col("copies") - 1).cast("int"))).alias("one"), "fp", F.col("d").alias("next_d"), F.col("t").alias("next_t"), F.col("fp").alias("next_fp")).drop("one")
    rows = cut(led.drop("copies").unionByName(again).withColumn("rid", F.monotonically_increasing_id()), "native-rows")
    texts = _base(docs, id_col, text_col).dropDuplicates(["d", "t"])
    tail = F.floor(F.col("n") / 4).cast("int")
    heads = rows.select("rid", F.col("d").alias("own_d"), F.col("t").alias("own_t"), "n", F.col("next_d").alias("d"), F.col("next_t").alias("t")).join(texts.hint("merge"), ["d", "t"]).select("rid", F.col("own_d").alias("d"), F.col("own_t").alias("t"), "n", F.substring("text", F.lit(1), tail).alias("head"))
    made = heads.hint("merge").join(texts, ["d", "t"]).select("rid", F.concat(F.substring("text", F.lit(1), (F.col("n") - tail).cast("int")), F.col("head")).alias("text"))
    sha = F.sha2("text", 256)
    quarters = [F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10).cast("long").alias(f"q{k}") for k in range(4)]
    terms = made.select("rid", sha.alias("sha"), _words("text").alias("words")).select("rid", *quarters, F.explode_outer(_terms("words")).alias("h"))
    votes = terms.groupBy("rid").agg(*[F.max(f"q{k}").alias(f"q{k}") for k in range(4)], F.count("h").alias("w"), *_votes("h"))
    done = votes.select("rid", F.concat(*[to_hex(F.col(f"q{k}")) for k in range(4)]).alias("edited_sha256"), F.coalesce(_majority(F.col("w")), F.lit(0)).alias("edited_fp"))
    asked = rows.where(F.pmod("d", F.lit(20)) == 0).select("fp").distinct()
    every = prints.select("fp").distinct()
    near = within(every, asked, n=every.count()).groupBy(F.col("query").alias("fp")).agg(F.count("*").alias("near_texts"))
    out = cut(rows.hint("merge").join(done, "rid"), "native-done")  # two readers: texts are hashed once
    out = out.where(F.pmod("d", F.lit(20)) == 0).join(near.hint("merge"), "fp", "left").unionByName(out.where(F.pmod("d", F.lit(20)) != 0).withColumn("near_texts", F.lit(None).cast("long")), allowMissingColumns=True)
    return out.select(
        F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", to_hex(F.col("fp")).alias("fingerprint"), to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "near_texts",
    )


KEY_ROWS = 16  # fingerprints that a table's key is meant to have


def _blocks(n: int, radius: int) -> int:
    """Blocks to cut 64 bits into so that keys of the agreeing ones split n fingerprints finely enough."""
    for b in range(radius + 1, 2 * radius + 2):
        if n <= KEY_ROWS << (64 * (b - radius) // b):
            return b
    return 2 * radius + 1


def within(index: DataFrame, queries: DataFrame, radius: int = RADIUS, n: int = 0, blocks: int | None = None) -> DataFrame:
    """(query, fp, bits): all index fingerprints (fp, distinct) within radius of the query fingerprints (fp, distinct).

    n: about how many fingerprints the index has. The more there are, the more blocks, and the longer are the keys: a
    table for every choice of the blocks that agree, so that what meets under a key grows with n and not its square. Rows
    under one key are dealt to SALT parts; each query asks them all.
    """
    b = blocks or _blocks(n, radius)
    edges = [64 * i // b for i in range(b + 1)]
    block = lambda c, k: F.shiftrightunsigned(c, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    kept = list(itertools.combinations(range(b), b - radius))
    # the kept blocks moved to the front, as one number
    front = lambda c, ks: reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(block(c, k), sum(edges[j + 1] - edges[j] for j in ks[:i])) for i, k in enumerate(ks)])
    tables = lambda c: F.explode(F.array(*[F.struct(F.lit(no).alias("no"), front(c, ks).alias("front")) for no, ks in enumerate(kept)]))
    left = queries.select(F.col("fp").alias("query"), tables(F.col("fp")).alias("at")).select("query", "at.no", "at.front", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    right = index.select("fp", tables(F.col("fp")).alias("at")).select("fp", "at.no", "at.front", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int").alias("salt"))
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.lit(len(kept))
    for no in reversed(range(len(kept))):  # the first table that a pair shares reports it
        first = F.when(front(differ, kept[no]) == 0, F.lit(no)).otherwise(first)
    same = (F.col("l.no") == F.col("r.no")) & (F.col("l.front") == F.col("r.front")) & (F.col("l.salt") == F.col("r.salt"))
    met = left.alias("l").join(right.alias("r").hint("merge"), same).where(F.bit_count(differ) <= radius)
    return met.where(first == F.col("l.no")).select("query", "fp", F.bit_count(differ).alias("bits"))
