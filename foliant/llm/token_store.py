"""Token-id shards with a minimal perfect hash index.

Documents are encoded in ascending id order into shard files of raw ids. Each shard ends with an index that maps a
document key to its place: a minimal perfect hash (hash and displace) over the keys, and in each of its slots the
offset, length and a stored 32-bit fingerprint of the key, which turns away keys that the shard doesn't have.

File: header (struct HEADER), ids (little-endian, 2 or 4 bytes each), document keys (int64), occurrence numbers
(uint32), null flags (uint8), displacements (int32), then per slot offsets (uint64), lengths (uint64), fingerprints
(uint32).

Defined cases: null text counts as empty and gives the end id alone; rows with the same id are told apart by an
occurrence number, in the order in which they stand in the file; null ids sort first and are kept; no rows give no
shards and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import cut, fresh_path, open_fs, pick, slices
from foliant.llm.token_cache import ByteLevel, cached

HEADER = struct.Struct("<4sBBHQQQ")  # magic, version, bytes an id, -, documents, ids, displacements
MAGIC = b"FTOK"
SHARD_IDS = 16_000_000  # a shard is closed once it holds this many ids
KEYS_A_BUCKET = 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    x = _mix(ids.astype(np.int64).view(np.uint64) + _GOLDEN)
    return _mix(x ^ (occurrence.astype(np.uint64) * _GOLDEN + null.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (_mix(h + (d.astype(np.uint64) + np.uint64(1)) * _GOLDEN) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Maps n distinct 64-bit hashes one to one onto 0..n-1."""

    def __init__(self, displacement: np.ndarray, n: int):
        self.displacement, self.n = displacement, n

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        r = max(1, -(-n // KEYS_A_BUCKET))
        bucket = (hashes % np.uint64(r)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=r)
        starts = np.cumsum(sizes) - sizes
        out, taken = np.zeros(r, dtype=np.int32), np.zeros(n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable"):
            size = sizes[b]
            if size < 2:
                break
            h, at = hashes[order[starts[b] : starts[b] + size]], 0
            while True:
                d = np.arange(at, at + 64)
                slots = np.sort(_slot(h[None, :], d[:, None], n), axis=1)
                ok = ~taken[slots].any(1) & (np.diff(slots, axis=1) != 0).all(1)
                if ok.any():
                    k = int(ok.argmax())
                    out[b] = at + k
                    taken[slots[k]] = True
                    break
                at += 64
                if at > 1 << 28:
                    raise ValueError("equal key hashes")
        single = np.flatnonzero(sizes == 1)
        out[single] = -np.flatnonzero(~taken)[: len(single)] - 1
        return cls(out, n)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        d = self.displacement[(hashes % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64)
        return np.where(d < 0, -d - 1, _slot(hashes, np.maximum(d, 0), max(1, self.n)))


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _occurrences(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each, in sorted order."""
    n = len(ids)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    at = np.arange(n)
    return (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint32)


def write_shard(path: str, ids: list[int | None], encoded: list[bytes], width: int) -> int:
    """Writes one shard; gives its number of ids."""
    null = np.array([i is None for i in ids], dtype=np.uint8)
    keys = np.array([0 if i is None else i for i in ids], dtype=np.int64)
    occurrence = _occurrences(keys, null)
    lengths = np.array([len(e) // width for e in encoded], dtype=np.uint64)
    offsets = np.cumsum(lengths) - lengths
    hashes = key_hash(keys, occurrence, null)
    index = PerfectHash.build(hashes)
    slot = index.slots(hashes)
    at = np.empty(len(ids), dtype=np.int64)
    at[slot] = np.arange(len(ids))
    total = int(lengths.sum())
    fs, name = open_fs(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(name) as out:
        out.write(HEADER.pack(MAGIC, 1, width, 0, len(ids), total, len(index.displacement)))
        for e in encoded:
            out.write(e)
        for a in (keys, occurrence, null, index.displacement, offsets[at], lengths[at], _fingerprint(hashes)[at]):
            out.write(np.ascontiguousarray(a).tobytes())
    return total


class Shard:
    """Keyed access to one shard: reads the index once, then one byte range for each document."""

    def __init__(self, path: str):
        fs, name = open_fs(path)
        self.file = fs.open_input_file(name)
        magic, version, self.width, _, self.n, self.tokens, r = HEADER.unpack(self._at(0, HEADER.size))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{path} is no token shard")
        self.dtype = np.dtype(f"<u{self.width}")
        at = HEADER.size + self.tokens * self.width
        parts = []
        for kind, count in (("<i8", self.n), ("<u4", self.n), ("u1", self.n), ("<i4", r), ("<u8", self.n), ("<u8", self.n), ("<u4", self.n)):
            size = np.dtype(kind).itemsize * count
            parts.append(np.frombuffer(self._at(at, size), dtype=kind))
            at += size
        self.keys, self.occurrence, self.null, displacement, self.offsets, self.lengths, self.prints = parts
        self.index = PerfectHash(displacement, self.n)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def find(self, ids: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) for each key."""
        h = key_hash(ids, occurrence, null)
        if not self.n:
            return np.zeros(len(h), bool), np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        slot = self.index.slots(h)
        return self.prints[slot] == _fingerprint(h), self.offsets[slot], self.lengths[slot]

    def ids(self, offset: int, length: int) -> np.ndarray:
        return np.frombuffer(self._at(HEADER.size + int(offset) * self.width, int(length) * self.width), dtype=self.dtype)

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document, or None if the shard doesn't have it."""
        found, offset, length = self.find(np.array([doc_id or 0]), np.array([occurrence]), np.array([doc_id is None]))
        return self.ids(offset[0], length[0]) if found[0] else None

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes docs (doc_id, text) as shards in ascending doc_id; gives their manifest (part, seq, path, docs, ids)."""
    folder = fresh_path(docs.sparkSession, "token-shards")
    parts = max(1, docs.rdd.getNumPartitions())
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq = cached(ByteLevel, tokenizer), TaskContext.get().partitionId(), 0
        width, end = tok.dtype.itemsize, tok.pack([end_id])
        ids: list = []
        encoded: list[bytes] = []
        held = 0

        def close():
            path = f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            total = write_shard(path, ids, encoded, width)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "docs": [len(ids)], "ids": [total]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

        for b in slices(batches, 1):
            ids += b.column(0).to_pylist()
            new = [e + end for e in tok.encode_many([t or "" for t in b.column(1).to_pylist()])]
            encoded += new
            held += sum(map(len, new)) // width
            if held >= shard_ids:
                yield close()
                ids, encoded, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    return cut(rows.mapInArrow(run, "part int, seq int, path string, docs long, ids long"), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each found through its shard's index."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    count = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(path)
                found, offset, length = s.find(s.keys, s.occurrence, s.null)
                if not found.all():
                    raise ValueError(f"{path}: the index misses documents of its shard")
                crc = [zlib.crc32(s.ids(o, n).astype("<u4").tobytes()) for o, n in zip(offset.tolist(), length.tolist())]
                s.close()
                yield pa.RecordBatch.from_arrays([pa.array(s.keys, pa.int64(), mask=s.null.astype(bool)), pa.array(offset.astype(np.int64) + start), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("path", "start").repartition(min(count, 4 * manifest.sparkSession.sparkContext.defaultParallelism + count // 64), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
