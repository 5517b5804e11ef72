"""A written inverted index over the text columns of a table, with later changes as further segments.

A segment holds postings (term, id, col, tf, positions, dl) in folders by hash of the term, sorted by term and id, so that
a query reads the row groups of its own terms; dl is the length of the row. Rows are tokenised and grouped by term inside
the row, so what is shuffled is one record a term and row, never the occurrences. A frequent term's folder is dealt over
as many files as its size asks for. Every row leaves a mark (bucket -1), by which changes hide the rows of earlier
segments and the corpus statistics are counted. A segment counts once its manifest is written.
"""

from __future__ import annotations

import hashlib
import re
import time
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.fts import Bm25, evaluate
from foliant.plans.parser import leaves
from foliant.session import ship, work_dir

BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 16, 1 << 16
MARKS = -1
_ASCII = re.compile("[a-z0-9]+")
_RUNS, _MARKS = regex.compile(r"[\p{L}\p{N}\p{Co}]+"), regex.compile(r"\p{M}+")


def words_of(text: str | None) -> list[str]:
    """The words that parser.tokenize gives."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _RUNS.findall(_MARKS.sub("", unicodedata.normalize("NFD", text)).lower())


def _postings(n_columns: int):
    def group(ids: list, texts: list[list[str | None]]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        term, row, col, pos, dl = [], [], [], [], np.zeros(len(ids), dtype=np.int64)
        for k, column in enumerate(texts):
            for i, text in enumerate(column):
                words = words_of(text)
                if not words:
                    continue
                term.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)))
                row.append(np.full(len(words), i))
                col.append(np.full(len(words), k))
                pos.append(np.arange(len(words), dtype=np.int32))
                dl[i] += len(words)
        names = ["term", "id", "col", "tf", "positions", "dl"]
        one = np.zeros(len(ids), dtype=np.int32)
        empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(ids) + 1, dtype=np.int32)), pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([""] * len(ids)), pa.array(ids, pa.int64()), pa.array(one), pa.array(one), empty, pa.array(dl)], names=names)
        if not term:
            return
        t, r, c, p = (np.concatenate(x) for x in (term, row, col, pos))
        order = np.lexsort((p, c, t, r))
        t, r, c, p = t[order], r[order], c[order], p[order]
        first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1]))))
        size = np.diff(np.append(first, len(t)))
        words, own = pa.array(list(known)), np.array(ids, dtype=np.int64)
        for k in range(0, len(first), 20_000):
            f, n = first[k : k + 20_000], size[k : k + 20_000]
            at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(t[f])), pa.array(own[r[f]]), pa.array(c[f].astype(np.int32)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(p[f[0] : f[0] + at[-1]])), pa.array(dl[r[f]])], names=names
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(ids):  # a slice of about a million characters at a time
                upto, chars = at, 0
                while upto < len(ids) and (chars < 1 << 20 or upto == at):
                    chars += sizes[upto]
                    upto += 1
                yield from group(ids[at:upto], [b.column(2 + k).slice(at, upto - at).to_pylist() for k in range(n_columns)])
                at = upto

    return run


def _shift(k: int):
    """Where a phrase begins whose k-th word stands at a position; columns lie far apart."""
    return lambda p: p - k + F.col("col") * (1 << 30)


class Index:
    """Segments under a folder; ``refresh`` sees what others have written since."""

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.refresh()

    def refresh(self) -> None:
        rows = self.spark.read.schema("no long, name string, buckets int, n long, tokens long, columns array<string>, base boolean").json(f"{self.path}/manifest")
        newest = sorted(rows.collect(), key=lambda r: r["no"])  # one row a segment
        start = max(k for k, r in enumerate(newest) if r["base"])
        self.segments = newest[start:]
        self.columns = list(self.segments[-1]["columns"])
        self.n, self.tokens = self.segments[-1]["n"], self.segments[-1]["tokens"]
        schema = "term string, id long, col int, tf int, positions array<int>, dl long, bucket int"
        self.parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{r['name']}") for r in self.segments]

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, columns: list[str]) -> Index:
        """Indexes rows (key long, unique; text columns) as the only content."""
        spark = rows.sparkSession
        ship(spark)
        path = path.rstrip("/")
        name, buckets = cls._write(rows, path, key, columns)
        marks = spark.read.parquet(f"{path}/{name}").where(F.col("bucket") == MARKS)
        n, tokens = marks.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        cls._commit(spark, path, name, buckets, n, tokens, columns, True)
        return cls(spark, path)

    @classmethod
    def _write(cls, rows: DataFrame, path: str, key: str, columns: list[str], gone: DataFrame | None = None) -> tuple[str, int]:
        """Writes a segment; rows in ``gone`` (id) leave a mark without a length."""
        leaf = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(min(1 << 60, int(str(leaf.apply(k).stats().sizeInBytes()))) for k in range(leaf.size()))
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET_BYTES))
        chars = reduce(lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)) for c in columns])
        made = rows.select(F.col(key).cast("long").alias("id"), chars.cast("long").alias("size"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(_postings(len(columns)), "term string, id long, col int, tf int, positions array<int>, dl long")
        if gone is not None:
            none = gone.select(F.lit("").alias("term"), F.col("id").cast("long").alias("id"), F.lit(0).alias("col"), F.lit(0).alias("tf"), F.array().cast("array<int>").alias("positions"), F.lit(None).cast("long").alias("dl"))
            made = made.unionByName(none)
        return cls._sorted(made, path, buckets), buckets

    @staticmethod
    def _sorted(made: DataFrame, path: str, buckets: int) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        bucket = F.when(F.col("term") == "", F.lit(MARKS)).otherwise(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int"))
        made.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/{name}")
        return name

    @staticmethod
    def _commit(spark: SparkSession, path: str, name: str, buckets: int, n: int, tokens: int, columns: list[str], base: bool) -> None:
        row = spark.createDataFrame([(time.time_ns(), name, buckets, n, tokens, columns, base)], "no long, name string, buckets int, n long, tokens long, columns array<string>, base boolean")
        row.coalesce(1).write.mode("append").json(f"{path}/manifest")

    def _hiding(self, k: int) -> DataFrame | None:
        """Ids that segments after the k-th have replaced or removed."""
        later = [p.where(F.col("bucket") == MARKS).select("id") for p in self.parts[k + 1 :]]
        return reduce(DataFrame.unionByName, later).distinct() if later else None

    def _live(self, wanted) -> DataFrame:
        """Postings that count, of the buckets and terms that ``wanted`` picks for a segment's number of buckets."""
        out = []
        for k, (r, p) in enumerate(zip(self.segments, self.parts)):
            own, hidden = p.where(wanted(r["buckets"])), self._hiding(k)
            out.append(own if hidden is None else own.join(hidden, "id", "left_anti"))
        return reduce(DataFrame.unionByName, out)

    def marks(self) -> DataFrame:
        """(id, dl) of the rows in the index."""
        return self._live(lambda _: F.col("bucket") == MARKS).where("dl is not null").select("id", "dl")

    def update(self, rows: DataFrame, key: str, gone: DataFrame | None = None) -> None:
        """Puts rows in the place of those with their ids, and takes out the ids in ``gone`` (id)."""
        changed = rows.select(F.col(key).cast("long").alias("id"))
        removed = None if gone is None else gone.select(F.col("id").cast("long").alias("id")).distinct().join(changed, "id", "left_anti")
        name, buckets = self._write(rows, self.path, key, self.columns, removed)
        new = self.spark.read.schema(self.parts[0].schema).parquet(f"{self.path}/{name}").where(F.col("bucket") == MARKS)
        lost = self.marks().join(new.select("id"), "id", "left_semi")
        sums = lambda d: d.agg(F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        (a, b), (c, d) = sums(new), sums(lost)
        self._commit(self.spark, self.path, name, buckets, self.n + a - c, self.tokens + b - d, self.columns, False)
        self.refresh()

    def delete(self, gone: DataFrame) -> None:
        """Takes out the ids in ``gone`` (id)."""
        none = gone.select("id", *[F.lit(None).cast("string").alias(c) for c in self.columns]).where(F.lit(False))
        self.update(none, "id", gone)

    def compact(self) -> None:
        """Writes what counts as one segment; statistics are counted anew."""
        live = self._live(lambda _: F.lit(True)).where("dl is not null").drop("bucket")
        buckets = max(r["buckets"] for r in self.segments)
        name = self._sorted(live, self.path, buckets)
        n, tokens = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("bucket") == MARKS).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self._commit(self.spark, self.path, name, buckets, n, tokens, self.columns, True)
        self.refresh()

    def counts(self, tree) -> DataFrame:
        """(id, dl, tf0..) of the rows that have some leaf."""
        exact = sorted({t for x in leaves(tree) for k, t in enumerate(x.terms) if not (x.prefix and k == len(x.terms) - 1)})
        starts = sorted({x.terms[-1] for x in leaves(tree) if x.prefix})

        def wanted(buckets: int):
            term = reduce(lambda a, b: a | b, [F.col("term") == t for t in exact] + [F.col("term").startswith(s) for s in starts], F.lit(False))
            where = F.col("bucket") != MARKS if starts else F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % buckets for t in exact}))
            return where & term

        out = []
        for x in leaves(tree):
            own = [F.col("term").startswith(t) if x.prefix and k == len(x.terms) - 1 else F.col("term") == t for k, t in enumerate(x.terms)]
            if len(own) == 1:
                out.append(F.sum(F.when(own[0], F.col("tf")).otherwise(F.lit(0))))
            else:  # a phrase: positions of each word shifted to its beginning, and those that all words share
                shifted = [F.flatten(F.collect_list(F.when(o, F.transform("positions", _shift(k))))) for k, o in enumerate(own)]
                out.append(F.size(reduce(F.array_intersect, shifted)))
        return self._live(wanted).groupBy("id").agg(F.max("dl").alias("dl"), *[c.cast("long").alias(f"tf{k}") for k, c in enumerate(out)])

    def match(self, tree, bm25: Bm25 = Bm25()) -> DataFrame:
        """(id, score) of matching rows."""
        if not leaves(tree):
            return self.spark.createDataFrame([], "id long, score double")
        found = self.counts(tree)
        n = found.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"_n{k}") for k in range(len(leaves(tree)))])
        matches, score = evaluate(tree, bm25)
        known = found.withColumns({"_n": F.lit(self.n), "_avgdl": F.lit(self.tokens / max(1, self.n))})
        return known.crossJoin(F.broadcast(n)).where(matches).select("id", score.alias("score"))  # one row is broadcast


_opened: dict[tuple[str, str], Index] = {}


def shared(spark: SparkSession, source: str, rows: DataFrame, key: str, columns: list[str]) -> Index:
    """The index of a source, built at its first use in an application and then read."""
    at = (spark.sparkContext.applicationId, source)
    if at not in _opened:
        name = hashlib.sha256(source.encode()).hexdigest()[:16]
        _opened[at] = Index.build(rows, f"{work_dir(spark)}/foliant/{spark.sparkContext.applicationId}/index-{name}-{uuid.uuid4().hex}", key, columns)
    return _opened[at]
