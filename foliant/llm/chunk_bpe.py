"""Byte-level BPE over overlapping chunks.

Texts longer than a chunk are cut into chunks that overlap; chunks are dealt out and each is split into pre-tokens for
itself. A chunk may begin inside a pre-token, so its first cuts can be wrong; from the first cut in the overlap that two
neighbours share, both go on alike, because a match of the pattern looks at nothing before its start. There the
neighbours are stitched, and the pieces are encoded. Where an overlap has no shared cut (a pre-token longer than the
overlap), the rest of the text is split anew from the last sure cut. Decoding joins the raw bytes of the ids.

Defined cases: null text counts as empty and has no ids; an empty text has the digests of no bytes; null ids and
repeated rows are kept; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import held, open_fs, pick, slices

CHUNK = 32_768
OVERLAP = 256
MARGIN = 4  # characters before a chunk's end whose cuts the missing text could change
MAX_PIECES = 1_000_000


class Codec:
    """Ranks, the split pattern, and a bounded cache of encoded pieces."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        fs, name = open_fs(ranks_path)
        with fs.open_input_stream(name) as f:
            pairs = [line.split() for line in f.read().splitlines() if line]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.core = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(pattern)
        self.raw: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def cuts(self, text: str) -> np.ndarray:
        """Ends of the pre-tokens of text."""
        return np.cumsum([len(p) for p in self.pieces(text)]).astype(np.int64)

    def encode(self, pieces: list[str]) -> np.ndarray:
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > MAX_PIECES:
            self.known.clear()
            new = set(pieces)
        for p in new:
            self.known[p] = np.array(self.core.encode_single_piece(p.encode("utf-8")), dtype="<u4").tobytes()
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


def codec(ranks_path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return held((ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def stitch(chunks: list[str], cuts: list[np.ndarray], c: Codec, chunk: int = CHUNK) -> list[str]:
    """The pre-tokens of the text whose overlapping chunks and their own cuts are given in order."""
    out: list[str] = []
    sure = 0  # up to here, in the whole text, pieces are out
    for k, (text, own) in enumerate(zip(chunks, cuts)):
        begin = k * chunk
        if k + 1 < len(chunks):
            low, high = (k + 1) * chunk, begin + len(text) - MARGIN
            here = own + begin
            there = np.concatenate(([0], cuts[k + 1])) + low
            both = np.intersect1d(here[(here >= low) & (here <= high)], there)
            if not len(both):
                rest = text[sure - begin :] + "".join(t[max(0, sure - j * chunk, len(chunks[j - 1]) - chunk) :] for j, t in enumerate(chunks) if j > k)
                return out + c.pieces(rest)
            until = int(both[0])
        else:
            until = begin + len(text)
        edges = own[(own + begin > sure) & (own + begin <= until)].tolist()
        last = sure - begin
        for e in edges:
            out.append(text[last:e])
            last = e
        sure = until
    return out


def _digest(c: Codec, pieces: list[str]) -> tuple[int, str, str]:
    ids = c.encode(pieces)
    return len(ids), hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text)."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in slices(batches, 1):
            rows = [_digest(c, c.pieces(t or "")) for t in b.column(1).to_pylist()]
            n, ids, raw = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                parts = [text[at : at + chunk + overlap] for at in range(0, len(text), chunk)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["row", "doc_id", "k", "part"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            cuts = [c.cuts(t).tolist() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cuts, pa.list_(pa.int64()))], names=["row", "doc_id", "k", "part", "cuts"])

    def join(key, rows: pd.DataFrame) -> pd.DataFrame:
        c = codec(ranks_path, pattern)
        rows = rows.sort_values("k")
        pieces = stitch(rows["part"].tolist(), [np.asarray(x) for x in rows["cuts"]], c, chunk)
        return pd.DataFrame([(rows["doc_id"].iloc[0], *_digest(c, pieces))], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    parts = rows.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut_up, "row long, doc_id long, k int, part string")
    cuts = parts.repartition(tasks, "row", "k").mapInArrow(split, "row long, doc_id long, k int, part string, cuts array<long>")
    return rows.where(~long).mapInArrow(short, SCHEMA).unionByName(cuts.groupBy("row").applyInPandas(join, SCHEMA))
