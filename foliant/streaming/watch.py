"""Change streams: pairing of renames, debouncing, application to snapshots, and rescans by the hour."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions.paths import is_under_any, top_two
from foliant.operators import store
from foliant.session import ship
from foliant.sources import extract
from foliant.sources.snapshots import Snapshots

PAIRED = "root string, seq long, action string, path string, new_path string"


def read_changes(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """A stream of raw records (ts, root, seq, action, path) from Parquet files."""
    return spark.readStream.schema("ts timestamp, root string, seq long, action string, path string").option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def _pairing(wait_ms: int):
    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Old names wait in the state for the record after them; when none comes in time they are deletions."""
        held = state.get if state.exists else None  # (seq, path, ts in ms)
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((key[0], held[0], "deleted", held[1], None))
            held = None
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples():
                if held is not None:
                    out.append((key[0], held[0], "renamed", held[1], r.path))
                    held, taken = None, r.action == "new_name"
                    if taken or r.action != "old_name":
                        continue
                if r.action == "old_name":
                    held = (int(r.seq), r.path, int(r.ts.timestamp() * 1000))
                elif r.action != "new_name":
                    out.append((key[0], int(r.seq), r.action, r.path, None))
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(max(held[2] + wait_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["root", "seq", "action", "path", "new_path"])

    return pair


def pair_renames(raw: DataFrame, late: str = "10 seconds", wait_ms: int = 10_000) -> DataFrame:
    """Paired changes of a stream of raw records; state is one old name a root.

    Time is the records' own (ts): an old name becomes a deletion once the watermark, ``late`` behind the newest record,
    is ``wait_ms`` past it. Records behind the watermark are dropped.
    """
    ship(raw.sparkSession)
    return raw.withWatermark("ts", late).groupBy("root").applyInPandasWithState(_pairing(wait_ms), PAIRED, "seq long, path string, ts long", "append", GroupStateTimeout.EventTimeTimeout)


def debounced(events: DataFrame, gap: str, late: str) -> DataFrame:
    """The last event of each session of a stream (key, ts, value); ``late`` bounds the state."""
    w = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w"))
    return w.agg(F.max_by("value", "ts").alias("value"), F.count("*").alias("n"), F.max("ts").alias("ts")).drop("w")


def apply_to(snapshots: Snapshots, name: str = "files", excludes: list[str] = ()):
    """A foreachBatch handler: folds a batch of changes and writes the next snapshot, once for each batch id.

    Paths in or below an excluded folder neither come in nor are indexed anew; that they go is still applied.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if snapshots.has_batch(batch_id):
            return
        files = snapshots.read(name)
        moved = batch.where("action = 'renamed'").select("ts", "seq", F.lit("added").alias("action"), F.col("new_path").alias("path"))
        every = batch.select("ts", "seq", "action", "path").unionByName(moved)
        folded = store.fold_changes(every.where(~F.col("action").isin("added", "modified") | ~is_under_any(F.col("path"), list(excludes))))
        snapshots.write({name: store.apply_changes(files, folded)}, batch_id)

    return handle


def rescan(spark: SparkSession, snapshots: Snapshots, name: str = "files", excludes: list[str] = ()):
    """One rescan of the folders that indexed paths lie in: walks them, hashes each file's first 64 MiB and upserts.

    Gives the number of the snapshot written.
    """
    files = snapshots.read(name)
    roots = [r["root"] for r in files.select(top_two(F.col("path")).alias("root")).distinct().collect()]  # two levels of folders
    found = extract.scan(spark, [r for r in roots if extract.exists(spark, r)], excludes)
    new = found.select("path", "filename", "extension", "size", "modified_date").join(extract.hashed(spark, found, 64 << 20), "path")
    merged = store.number_new(store.upsert(files, new)).drop("change")
    first = found.select("path", F.col("indexing_status").alias("_i"), F.col("ocr_status").alias("_o"))
    status = {"indexing_status": F.coalesce("indexing_status", "_i")} | ({"ocr_status": F.coalesce("ocr_status", "_o")} if "ocr_status" in files.columns else {})
    return snapshots.write({name: merged.join(first, "path", "left").withColumns(status).drop("_i", "_o").select(*files.columns)})


def hourly(spark: SparkSession, snapshots: Snapshots, checkpoint: str, name: str = "files", excludes: list[str] = (), every: str = "1 hour"):
    """A running query that rescans at each trigger; ``awaitTermination`` or ``stop`` it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(batch: DataFrame, batch_id: int) -> None:
        rescan(spark, snapshots, name, excludes)

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
