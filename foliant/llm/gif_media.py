"""GIF media columns: payload bytes stored as timed 8-bit frames, and decoded again.

The writer stores samples without loss as palette indices of 64 pixels a row, in frames of at most FRAME_ROWS rows, with
variable-width LZW codes. The reader takes any GIF: it decodes the LZW code streams, applies global or local
palettes, transparency, interlacing and the disposal rules, and gives each frame with its time and colour histogram.

LZW decoding is done on whole arrays: a code above the clear code stands for a stretch of the output that begins where
an earlier code's text begins, so every output byte has a pointer to an earlier byte and pointer doubling fills them.

Defined cases: null text counts as empty, and an empty text is stored as 64 zero bytes; very long texts take more
frames; null ids and repeated rows are kept; equal texts give equal media; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, pick

WIDTH = 64
FRAME_ROWS = 512
DELAY_CS = 4  # hundredths of a second a frame
BINS = 16
_GREY = bytes(v for i in range(256) for v in (i, i, i))


def _pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits, least significant bit first."""
    ends = np.cumsum(widths)
    at = ends - widths
    value, byte = codes.astype(np.int64) << (at & 7), at >> 3
    out = np.zeros(int(ends[-1] + 7) // 8 + 3)
    for k in range(3):  # codes don't share bits, so sums are unions
        out += np.bincount(byte + k, weights=value >> 8 * k & 255, minlength=len(out))[: len(out)]
    return out[:-3].astype(np.uint8).tobytes()


def _widths(lengths: list[int], least: int) -> np.ndarray:
    """Widths of the codes of stretches that each follow a clear code, the clear or end code that ends each included."""
    out = []
    for n in lengths:
        size = (1 << least) + 2 + np.maximum(np.arange(n) - 1, -1)  # entries known to the reader when it reads code k
        out.append(np.clip(np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1, least + 1, 12))
    return np.concatenate(out)


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples, with code sizes growing from 9 to 12 bits and a clear whenever 12 are used up."""
    codes: list[int] = [256]
    stretches: list[int] = []
    add, table = codes.append, {}
    get, free, since, rest = table.get, 258, 1, iter(data)
    w = next(rest, -1)
    for c in rest:
        k = get(w << 8 | c)
        if k:
            w = k
            continue
        add(w)
        if free < 4095:
            table[w << 8 | c] = free
            free += 1
        else:
            add(256)
            stretches.append(len(codes) - since)
            since = len(codes)
            table.clear()
            free = 258
        w = c
    if w >= 0:
        add(w)
    add(257)
    stretches.append(len(codes) - since)
    widths = np.concatenate(([9], _widths(stretches, 8)))
    return _pack_codes(np.array(codes, dtype=np.uint16), widths)


def lzw_decode(stream: bytes, least: int, most: int) -> np.ndarray:
    """Up to ``most`` samples from a code stream with the given minimum code size."""
    clear, end = 1 << least, (1 << least) + 1
    n_bits = 8 * len(stream)
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    full, starts = _ladder(least)
    out, got, at = [], 0, 0
    while at + least + 1 <= n_bits and got < most:
        parts: list[np.ndarray] = []
        first = 0
        while True:  # codes up to the next clear or end
            upto = first + min(int(np.searchsorted(starts[first + 1 :], n_bits - at, side="right")), 4200)
            if upto <= first:
                break
            place = starts[first:upto] + at
            part = words[place >> 3] >> (place & 7) & ((1 << full[first:upto]) - 1)
            stop = np.flatnonzero((part == clear) | (part == end))
            parts.append(part[: stop[0] + 1] if len(stop) else part)
            first = upto
            if len(stop) or upto >= len(full) - 1:
                break
        if not parts:
            break
        codes = np.concatenate(parts)
        last = codes[-1]
        at += int(starts[len(codes)])
        body = codes[:-1] if last in (clear, end) else codes
        if len(body):
            out.append(_expand(body, clear, most - got))
            got += len(out[-1])
        if last == end:
            break
    return np.concatenate(out)[:most] if out else np.zeros(0, dtype=np.uint8)


@functools.cache
def _ladder(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear, and the bit at which each starts. The longest stretch taken is 2**22 codes."""
    full = _widths([1 << 22], least)
    return full.astype(np.int32), np.concatenate(([0], np.cumsum(full)))


def _expand(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """The samples of codes that follow one clear code."""
    n = len(codes)
    codes = codes.astype(np.int32)
    literal = codes < clear
    parent = np.where(literal, np.arange(n, dtype=np.int32), codes - (clear + 2))  # the earlier code whose text this one repeats, and one sample more
    if not literal[0] or (parent[~literal] >= np.flatnonzero(~literal)).any():
        raise ValueError("a code stands before its entry")
    size, up = (~literal).astype(np.int32), parent
    while True:  # steps to a literal, by doubling
        size = size + size[up]
        if literal[up].all():
            break
        up = up[up]
    size += 1
    ends = np.cumsum(size, dtype=np.int32)
    start = ends - size
    total = int(ends[-1])
    source = np.arange(total, dtype=np.int32) + np.repeat(start[parent] - start, size)
    value = np.zeros(total, dtype=np.uint8)
    value[start[literal]] = codes[literal]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return value[source][:most]
        source = further


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = DELAY_CS) -> bytes:
    """A GIF whose frames hold the samples, a positive multiple of width, row by row."""
    rows = len(samples) // width
    high = min(rows, frame_rows)
    out = [b"GIF89a", struct.pack("<HHBBB", width, high, 0xF7, 0, 0), _GREY]
    for top in range(0, rows, high):
        part = samples[top * width : (top + high) * width]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One image of a GIF: its indices as stored, the canvas as shown, and how long."""

    left: int
    top: int
    indices: np.ndarray
    canvas: np.ndarray
    delay: int
    disposal: int


def decode(media: bytes, canvas: bool = True) -> Iterator[Frame]:
    """The frames of a GIF; without ``canvas`` the shown pictures are left out."""
    if media[:3] != b"GIF":
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at, general = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        general, at = np.frombuffer(media, np.uint8, n, at).reshape(-1, 3), at + n
    shown = np.zeros((height, width), dtype="<u4") if canvas else None
    delay, disposal, clear = 0, 0, -1

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := media[at]:
            parts.append(media[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while media[at] != 0x3B:
        if media[at] == 0x21:
            label = media[at + 1]
            data, at = blocks(at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data)
                disposal, clear = packed >> 2 & 7, index if packed & 1 else -1
            continue
        left, top, w, h, flags = struct.unpack_from("<HHHHB", media, at + 1)
        at += 10
        palette = general
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            palette, at = np.frombuffer(media, np.uint8, n, at).reshape(-1, 3), at + n
        data, next_at = blocks(at + 1)
        flat = lzw_decode(data, media[at], w * h)
        indices = np.zeros(w * h, dtype=np.uint8)
        indices[: len(flat)] = flat
        indices, at = indices.reshape(h, w), next_at
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(indices)
            plain[order] = indices
            indices = plain
        if canvas:
            before = shown.copy() if disposal == 3 else None
            place = shown[top : top + h, left : left + w]
            if palette is None:
                raise ValueError("a frame has no palette")
            seen = indices[: place.shape[0], : place.shape[1]]
            colours = np.zeros(256, dtype="<u4")
            colours[: len(palette)] = palette.astype(np.uint32) @ np.array([1, 256, 65536], dtype=np.uint32) | np.uint32(0xFF000000)
            place[:] = np.where(seen == clear, place, colours[seen]) if clear >= 0 else colours[seen]
            yield Frame(left, top, indices, shown.copy().view(np.uint8).reshape(height, width, 4), delay, disposal)
            if disposal == 2:
                place[:] = 0
            elif disposal == 3:
                shown = before
        else:
            yield Frame(left, top, indices, np.zeros((0, 0, 4), np.uint8), delay, disposal)
        delay, disposal, clear = 0, 0, -1


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def histogram(rgb: np.ndarray) -> np.ndarray:
    """BINS shares for each of red, green and blue."""
    n = max(1, len(rgb))
    return np.concatenate([np.bincount(rgb[:, c] >> 4, minlength=BINS)[:BINS] for c in range(3)]) / n


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, media, held = [], [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                ids.append(doc)
                sizes.append(len((text or "").encode("utf-8")))
                media.append(encode(payload(text)))
                held += len(media[-1])
                if held > 8 << 20:
                    yield _batch(ids, sizes, media)
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield _batch(ids, sizes, media)

    def _batch(ids, sizes, media):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return cut(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "gif-media")


def frames(stored: DataFrame) -> DataFrame:
    """(doc_id, frame, at_ms, delay_ms, rows, histogram): the timed frames of stored media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, media in zip(b.column(0).to_pylist(), b.column(1)):
                out, at = [], 0
                for k, f in enumerate(decode(media.as_py())):
                    out.append((doc, k, at, 10 * f.delay, f.indices.shape[0], histogram(f.canvas.reshape(-1, 4)[:, :3]).tolist()))
                    at += 10 * f.delay
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[1:5]], pa.array(cols[5], pa.list_(pa.float64()))], names=["doc_id", "frame", "at_ms", "delay_ms", "rows", "histogram"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, frame int, at_ms int, delay_ms int, rows int, histogram array<double>")


def digests(stored: DataFrame) -> DataFrame:
    """What is read back from stored media: sizes, digests, the histogram of the grey shown, in BINS steps, and ``frames``.

    frames: an array of the timed frames, each with its time and delay in ms, its rows, and a histogram of BINS counts for
    each of red, green and blue.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                media = media.as_py()
                sha, tail, total, count, time, shots = hashlib.sha256(), b"", 0, np.zeros(BINS, dtype=np.int64), 0, []
                for f in decode(media):
                    h, w = f.indices.shape
                    shown = f.canvas[f.top : f.top + h, f.left : f.left + w, 0]
                    data = shown.tobytes()  # the grey palette shows a sample as itself
                    sha.update(data)
                    tail, total = (tail + data)[-WIDTH:], total + len(data)
                    own = np.bincount(shown.reshape(-1) >> 4, minlength=BINS)
                    count += own
                    place = f.canvas[f.top : f.top + h, f.left : f.left + w]
                    red, green, blue = (own if k == 0 or np.array_equal(place[:, :, k], shown) else np.bincount(place[:, :, k].reshape(-1) >> 4, minlength=BINS) for k in range(3))
                    shots.append({"at_ms": time, "delay_ms": 10 * f.delay, "rows": h, "red": red, "green": green, "blue": blue})
                    time += 10 * f.delay
                feature = f"{len(shots)}f{time}ms:" + ",".join(f"{c / total:.4f}" for c in count)
                rows.append((doc, n, total, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, shots))
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([*[(n, pa.int32()) for n in ("at_ms", "delay_ms", "rows")], *[(n, pa.list_(pa.int32())) for n in ("red", "green", "blue")]])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<at_ms:int,delay_ms:int,rows:int,red:array<int>,green:array<int>,blue:array<int>>>")
