"""Snapshots of tables in numbered folders: a version counts once its manifest is written, so readers never see half."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Versions under a folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifests(self) -> DataFrame | None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema("version long, batch_id long, app string, tables array<string>, bytes long, written timestamp").json(f"{self.path}/manifests")

    def versions(self) -> list[int]:
        """Newest first."""
        m = self._manifests()
        return [] if m is None else [r[0] for r in m.select("version").distinct().orderBy(F.desc("version")).collect()]  # one row a version

    def has_batch(self, batch_id: int) -> bool:
        m = self._manifests()
        return m is not None and not m.where(F.col("batch_id") == batch_id).isEmpty()

    def _claim(self) -> int:
        """The next version, claimed by creating its mark, which only one writer can do."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        version = (self.versions() or [0])[0] + 1
        while True:
            mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{version:08d}")
            fs = mark.getFileSystem(conf)
            if not fs.exists(mark):
                try:
                    if fs.createNewFile(mark):
                        return version
                except Exception as e:  # another writer was first
                    if not fs.exists(mark):
                        raise e
            version += 1

    def write(self, tables: dict[str, DataFrame], batch_id: int = -1) -> int:
        """Writes the next version. Two writers get two versions; the later number is the newest."""
        version = self._claim()
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(f"{self.path}/v{version:08d}/{name}")
        row = self.spark.createDataFrame([(version, batch_id, "foliant", list(tables), self._bytes(version))], "version long, batch_id long, app string, tables array<string>, bytes long")
        row.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.path}/manifests")
        return version

    def _bytes(self, version: int) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{version:08d}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()

    def history(self) -> DataFrame:
        """(version, written, bytes, tables, app, batch_id), newest first."""
        m = self._manifests()
        if m is None:
            return self.spark.createDataFrame([], "version long, written timestamp, bytes long, tables array<string>, app string, batch_id long")
        return m.select("version", "written", "bytes", "tables", "app", "batch_id").orderBy(F.desc("written"), F.desc("version"))

    def compact(self, rows_a_file: int = 1_000_000) -> int:
        """A version with the newest tables in as few files as their rows ask for."""
        newest = self.versions()[0]
        names = self._manifests().where(F.col("version") == newest).first()["tables"]
        few = lambda t: t.repartition(max(1, -(-t.count() // rows_a_file)))
        return self.write({n: few(self.read(n, newest)) for n in names})

    def analyze(self, name: str) -> DataFrame:
        """(column, distinct, nulls) of the newest table: distinct counts are HyperLogLog estimates."""
        t = self.read(name)
        one = t.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(F.col(c).cast("string")).alias(f"d{k}") for k, c in enumerate(t.columns)], *[F.count_if(F.col(c).isNull()).alias(f"z{k}") for k, c in enumerate(t.columns)])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{k}").alias("distinct"), F.col(f"z{k}").alias("nulls")) for k, c in enumerate(t.columns)])
        return one.select(F.inline(rows))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version or self.versions()[0]:08d}/{name}")

    def restore(self, version: int) -> int:
        """Makes an old version the newest."""
        m = self._manifests()
        names = m.where(F.col("version") == version).first()["tables"]
        return self.write({n: self.read(n, version) for n in names})

    def clear(self) -> int:
        """A version whose tables are empty."""
        newest = self.versions()[0]
        names = self._manifests().where(F.col("version") == newest).first()["tables"]
        return self.write({n: self.read(n, newest).limit(0) for n in names})


def export_csv(hits: DataFrame, path: str) -> None:
    """Hits as CSV with a header and every field quoted and escaped."""
    hits.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, nulls: str = "NA", skip: int = 0) -> DataFrame:
    """CSV with a header after ``skip`` lines; lines that don't fit the schema are dropped.

    With lines to skip, each file is read from its beginning by one task; files are told apart by their names.
    """
    options = {"header": True, "escape": '"', "mode": "DROPMALFORMED", "nullValue": nulls}
    if not skip:
        return spark.read.schema(schema).options(**options).csv(path)
    parts = F.split("value", "\r?\n")
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(parts, F.lit(skip + 2), F.size(parts))).alias("value")).where("value <> ''")
    read = F.from_csv("value", f"{schema}, _bad string", {**{k: str(v) for k, v in options.items() if k not in ("header", "mode")}, "columnNameOfCorruptRecord": "_bad"})
    return lines.select(read.alias("r")).select("r.*").where("_bad is null").drop("_bad")


def read_many(spark: SparkSession, paths: list[str], schema: str, nulls: str = "NA") -> DataFrame:
    """Files of one schema under each other, with the name of each row's file in ``source_file``."""
    found = spark.read.schema(schema).options(header=True, escape='"', mode="DROPMALFORMED", nullValue=nulls).csv(list(paths))
    return found.withColumn("source_file", F.col("_metadata.file_name"))
