"""Vector best-fit packing of token pieces into sequences.

A piece needs three things of a sequence: tokens, one document place, and attention cost (its length squared). Pieces
are taken in descending length; each goes to the open sequence that can hold it under every capacity and that scores
best, by the weighted dot product of the piece's needs with what is left, or by the weighted norm of what would be
left over; if none can, a sequence is opened.

All pieces of one length are alike, and so are all sequences with the same amounts left, so the plan is made on counts:
the histogram of lengths (at most ``tokens`` rows, whatever the corpus) goes to the driver, which moves runs of equal
pieces onto runs of equal sequences. There are at most two runs of sequences for each length. The pieces themselves
never leave the executors: each gets its rank within its length and finds its run, hence sequence and offset.

Defined cases: null text counts as empty and gives its end id alone; only documents of more than ``tokens`` ids are
cut, into pieces of that many and a last one; repeated rows and null ids are packed like any others; no rows give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import cut, pick, slices
from foliant.llm.token_cache import SpaceFree, cached


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold, and how much each of the three counts when sequences are scored."""

    tokens: int = 2048
    documents: int | None = None  # None: no more than tokens allow
    attention: int | None = None  # None: no more than tokens allow
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"  # "norm": smallest weighted norm of what is left after; "dot": largest weighted dot product

    def limits(self) -> np.ndarray:
        t = self.tokens
        return np.array([t, t if self.documents is None else self.documents, t * t if self.attention is None else self.attention], dtype=np.int64)


def plan(counts: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, sequences, first sequence, pieces a sequence, offset) that place all pieces.

    Pieces first rank .. + sequences * pieces a sequence go to consecutive sequences, that many to each.
    """
    limits = cap.limits()
    weights = np.array(cap.weights) / limits.astype(float) ** 2
    left = np.empty((0, 3), dtype=np.int64)  # of each run of sequences
    start, number, used = (np.empty(0, dtype=np.int64) for _ in range(3))
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        need, rest, rank = np.array([length, 1, length * length]), counts[length], 0
        if (need > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while rest:
            fits = np.flatnonzero((left >= need).all(1))
            if len(fits):
                after = left[fits] - need
                value = (weights * after * after).sum(1) if cap.score == "norm" else -(weights * left[fits] * need).sum(1)
                g = fits[np.lexsort((start[fits], value))[0]]
            else:
                each = int((limits // need).min())
                each = max(1, min(each, rest))
                n = max(1, rest // each)
                left = np.vstack([left, limits])
                start, number, used = np.append(start, opened), np.append(number, n), np.append(used, 0)
                opened += n
                g = len(left) - 1
            # of a run all sequences stay alike: as many pieces into each as can follow by best fit in a row
            each = max(1, min(int((left[g] // need).min()), rest // int(number[g]))) if number[g] <= rest else 1
            take = min(int(number[g]), rest // each)
            if take < number[g]:  # the untouched sequences become a run of their own
                left, start, number, used = np.vstack([left, left[g]]), np.append(start, start[g] + take), np.append(number, number[g] - take), np.append(used, used[g])
                number[g] = take
            runs.append((length, rank, take, int(start[g]), each, int(used[g])))
            left[g] -= need * each
            used[g] += length * each
            rest -= take * each
            rank += take * each
        open_ = left[:, :2].min(1) > 0
        left, start, number, used = left[open_], start[open_], number[open_], used[open_]
    return runs


def pieces(docs: DataFrame, tokenizer: str, end_id: int, tokens: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, local): part and local number the pieces of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seen = cached(SpaceFree, tokenizer), TaskContext.get().partitionId(), np.zeros(tokens + 1, dtype=np.int64)
        end = tok.pack([end_id])
        for b in slices(batches, 1):
            out: list[tuple] = []
            for doc, e in zip(b.column(0).to_pylist(), tok.encode_many([t or "" for t in b.column(1).to_pylist()])):
                ids = np.frombuffer(e + end, dtype=tok.dtype).astype("<u4")
                for k, at in enumerate(range(0, len(ids), tokens)):
                    own = ids[at : at + tokens]
                    out.append((doc, k, at, len(own), zlib.crc32(own.tobytes()), part, int(seen[len(own)])))
                    seen[len(own)] += 1
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long")


def assign(table: DataFrame, cap: Capacity) -> DataFrame:
    """table (length, part, local, ...) with sequence_id and offset."""
    cells = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(cells.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most cap.tokens rows
    if not counts:
        return table.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")).where(F.lit(False))
    runs = np.array(plan(counts, cap), dtype=np.int64)
    span = int(max(counts.values())) + 1
    keys = runs[:, 0] * span + runs[:, 1]  # a length's runs follow each other by first rank
    order = np.argsort(keys)
    runs, keys = runs[order], keys[order]
    names = [c for c in table.columns if c not in ("part", "local")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            r = runs[np.searchsorted(keys, length * span + rank, side="right") - 1]
            nth = rank - r[:, 1]
            sequence, offset = r[:, 3] + nth // r[:, 4], r[:, 5] + nth % r[:, 4] * length
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    ranked = table.join(bases.select("length", "part", "base"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("local")).select(*names, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, cap: Capacity = Capacity()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs (doc_id, text)."""
    return assign(cut(pieces(docs, tokenizer, end_id, cap.tokens), "pack-pieces"), cap)
