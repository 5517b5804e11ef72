"""Token shards, stitched BPE, GIF media, WARC archives and packing: round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from foliant.llm import chunk_bpe, gif_media, token_store, vector_pack, warc_index
from foliant.llm.token_cache import ByteLevel, SpaceFree, cached

ODD = [None, "", " ", "  a  b\n\n\nc ", "don't I'LL 1234.5", "naïve CAFÉ É́", "x y . z", "<|endoftext|>", "日本 語", "word, word. word!!", "long " * 9000]
DOCS = "doc_id long, text string, ids string, length long"


def docs(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "clash", 1), (1, "again", "clash", 1), (1, "again", "clash", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("kind, name", [(ByteLevel, "byte_bpe_50k.json"), (SpaceFree, "word_bpe_49k.json")])
def test_cached_ids(kind, name):
    c = cached(kind, public_tokenizers.path(name))
    r = random.Random(1)
    parts = ["a", "Word", " ", "  ", "\n", "'s", "é", "É", ".", "!!", "\t", "\x1c", "\x85", "\xa0", "日", "İ", "12", "_", "|"]
    texts = [t or "" for t in ODD] + ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(400)]
    assert c.encode_many(texts) == [c.whole(t) for t in texts]


@pytest.mark.parametrize("kind, name", [(ByteLevel, "byte_bpe_50k.json"), (SpaceFree, "word_bpe_49k.json")])
def test_ids_of_the_library(kind, name):
    """The library's own encoding, set as its vocabulary's description says: special tokens' strings are ordinary text."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    own.encode_special_tokens = True
    c = cached(kind, public_tokenizers.path(name))
    texts = [t or "" for t in ODD] + ["<|startoftext|>x <|endoftext|>", "Äpfel, naïve-café's 3.14!!  x\r\ny"]
    assert [np.frombuffer(x, c.dtype).tolist() for x in c.encode_many(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_change_no_ids(monkeypatch):
    from foliant.llm import token_cache

    texts = [t or "" for t in ODD] * 3
    c = ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    want = c.encode_many(texts)
    monkeypatch.setattr(token_cache, "SLICE_CHARS", 20)
    monkeypatch.setattr(token_cache, "MAX_SEGMENTS", 5)
    assert ByteLevel(public_tokenizers.path("byte_bpe_50k.json")).encode_many(texts) == want


def test_token_starts(spark):
    """In ascending order of id, with ids apart, starts are the lengths of all before."""
    rows = [(i * 7 % 101, f"text {i} " * (i % 13), "c", 1) for i in range(101)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(tuple(r) for r in token_store.read(token_store.write(df, public_tokenizers.path("byte_bpe_50k.json"), 2, shard_ids=300)).collect())
    c, at = cached(ByteLevel, public_tokenizers.path("byte_bpe_50k.json")), 0
    for (i, t, _, _), g in zip(sorted(rows), got):
        n = len(c.whole(t)) // 2 + 1
        assert g[:3] == (i, at, n)
        at += n


def test_token_store(spark):
    df = docs(spark, ODD)
    manifest = token_store.write(df, public_tokenizers.path("byte_bpe_50k.json"), 2, shard_ids=5000)
    got = sorted(tuple(r) for r in token_store.read(manifest).fillna(-1, ["doc_id"]).collect())
    c, at, want = cached(ByteLevel, public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: x[0]):
        ids = np.append(np.frombuffer(c.whole(t), "<u2").astype("<u4"), np.uint32(2))
        want.append((i, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        at += len(ids)
    assert [g[0] for g in got] == [w[0] for w in want] and sum(g[2] for g in got) == at
    assert {(g[0], g[2], g[3]) for g in got} == {(w[0], w[2], w[3]) for w in want}
    shard = token_store.Shard(manifest.where("docs > 1").first()["path"])
    known = int(shard.keys[shard.null == 0][0])
    assert shard.get(known) is not None and shard.get(10**12) is None
    assert token_store.read(token_store.write(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 2)).count() == 0


def test_perfect_hash():
    keys = token_store.key_hash(np.arange(5000), np.zeros(5000), np.zeros(5000))
    for n in (1, 2, 3, 100, 5000):
        assert sorted(token_store.PerfectHash.build(keys[:n]).slots(keys[:n])) == list(range(n))


def test_stitched_bpe(spark):
    df = docs(spark, ODD + ["x" * 300 + " y", "ab 'll " * 60])
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = chunk_bpe.encode(df, path, pattern, chunk=64, overlap=24).collect()
    c = chunk_bpe.codec(path, pattern)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], *chunk_bpe._digest(c, c.pieces(r["text"] or ""))) for r in df.collect())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert all(d == hashlib.sha256((r or "").encode()).hexdigest() for r, d in [(None, chunk_bpe._digest(c, [])[2])])
    assert chunk_bpe.encode(df.limit(0), path, pattern).count() == 0


def test_bpe_like_tiktoken(spark):
    import base64

    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    parts = ["a", "Word", " ", "  ", "\n", "'s", "é", "É", ".", "!!", "\t", "\xa0", "日", "İ", "12", "_", "<|endoftext|>"]
    texts = ODD + ["".join(r.choices(parts, k=r.randint(0, 300))) for _ in range(60)]
    got = {x["doc_id"]: x for x in chunk_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, pattern, chunk=128, overlap=32).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def slow_gif(data):
    """(samples, delay) of each image, by the format's plain rules: one code after another, no vectors."""
    assert data[:6] == b"GIF89a"
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, out, delay = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), [], 0

    def blocks(at):
        body = b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        return body, at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9:
                delay = int.from_bytes(body[1:3], "little")
            continue
        w, h, own = int.from_bytes(data[at + 5 : at + 7], "little"), int.from_bytes(data[at + 7 : at + 9], "little"), data[at + 9]
        at += 10 + (3 << (own & 7) + 1 if own & 128 else 0)
        first = data[at]
        body, at = blocks(at + 1)
        bits, have, size, table, last, samples, k = 0, 0, first + 1, None, None, bytearray(), 0
        while True:
            while have < size:
                bits |= body[k] << have
                have, k = have + 8, k + 1
            code, bits, have = bits & (1 << size) - 1, bits >> size, have - size
            if code == 1 << first:
                table, size, last = [bytes([x]) for x in range(1 << first)] + [b"", b""], first + 1, None
                continue
            if code == (1 << first) + 1:
                break
            word = table[code] if code < len(table) else last + last[:1]
            samples += word
            if last is not None and len(table) < 4096:
                table.append(last + word[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            last = word
        assert len(samples) == w * h and w <= width and h <= height
        out.append((bytes(samples), delay))
    return out


def test_gif_by_another_decoder(spark):
    r = random.Random(9)
    texts = ODD + ["".join(r.choices("abcdefgh ÄÖ日", k=r.randint(0, 9000))) for _ in range(10)] + ["x" * 100_000]
    stored = gif_media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    out = {x["doc_id"]: x for x in gif_media.digests(stored).collect()}
    for x in stored.collect():
        frames, got = slow_gif(bytes(x["media"])), out[x["doc_id"]]
        payload = b"".join(f for f, _ in frames)
        assert payload == gif_media.payload(texts[x["doc_id"]])
        assert (got["media_bytes"], got["media_sha256"], got["payload_bytes"]) == (len(x["media"]), hashlib.sha256(x["media"]).hexdigest(), len(payload))
        at = 0
        assert len(got["frames"]) == len(frames)
        for (samples, delay), f in zip(frames, got["frames"]):
            counts = [sum(1 for b in samples if b >> 4 == k) for k in range(16)]
            assert (f["at_ms"], f["delay_ms"], f["rows"] * 64) == (at, 10 * delay, len(samples)) and f["red"] == f["green"] == f["blue"] == counts
            at += 10 * delay
        shares = [sum(1 for b in payload if b >> 4 == k) / len(payload) for k in range(16)]
        assert got["feature"] == f"{len(frames)}f{at}ms:" + ",".join(f"{s:.4f}" for s in shares)


def test_gif(spark):
    df = docs(spark, ODD)
    stored = gif_media.store(df)
    out = {(r["doc_id"], r["payload_sha256"]): r for r in gif_media.digests(stored).collect()}
    for r in df.collect():
        p = gif_media.payload(r["text"])
        got = out[r["doc_id"], hashlib.sha256(p).hexdigest()]
        assert (got["n_bytes"], got["payload_bytes"], got["tail_crc32"]) == (len((r["text"] or "").encode()), len(p), zlib.crc32(p[-64:]))
    assert gif_media.frames(stored).where("size(histogram) = 48").count() >= len(ODD)
    assert gif_media.digests(gif_media.store(df.limit(0))).count() == 0


def test_gif_rules():
    """Transparency, local palettes, interlacing and disposal, on a hand-made file of two-bit samples."""
    import struct

    def image(left, top, w, h, samples, flags=0, palette=b"", disposal=1, clear=None):
        codes = [c for s in samples for c in (4, s)] + [5]  # a clear before every sample keeps codes at 3 bits
        bits = np.array([c >> b & 1 for c in codes for b in range(3)], dtype=np.uint8)
        data = np.packbits(bits, bitorder="little").tobytes()
        head = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0) + b"\0"
        return head + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + palette + b"\x02" + bytes([len(data)]) + data + b"\0"

    black = bytes([0, 0, 0, 10, 0, 0, 20, 0, 0, 30, 0, 0])
    local = bytes([99, 0, 0, 98, 0, 0, 97, 0, 0, 96, 0, 0])
    gif = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + black
    gif += image(0, 0, 2, 2, [1, 1, 1, 1]) + image(0, 0, 2, 1, [2, 0], clear=0, disposal=3) + image(1, 1, 1, 1, [0], flags=0x81, palette=local, disposal=2) + image(0, 0, 1, 1, [3]) + b"\x3b"
    red = [f.canvas[:, :, 0].tolist() for f in gif_media.decode(gif)]
    assert red == [[[10, 10], [10, 10]], [[20, 10], [10, 10]], [[10, 10], [10, 99]], [[30, 10], [10, 0]]]
    rows = b"GIF89a" + struct.pack("<HHBBB", 1, 8, 0x81, 0, 0) + black + image(0, 0, 1, 8, [0, 1, 2, 2, 3, 3, 3, 3], flags=0x40) + b"\x3b"
    assert [f.indices[:, 0].tolist() for f in gif_media.decode(rows)] == [[0, 3, 2, 3, 1, 3, 2, 3]]


@pytest.mark.parametrize("size", [1, 64, 5000, 70000])
def test_lzw(size):
    r = np.random.default_rng(size)
    for data in (bytes(size), r.integers(0, 256, size, dtype=np.uint8).tobytes(), (b"abcab " * size)[:size]):
        assert gif_media.lzw_decode(gif_media.lzw_encode(data), 8, size).tobytes() == data


def test_warc(spark):
    big, other = "x" * 2000, "é" * 600
    rows = [(1, "http://a\r\nX: y", big, 0), (2, None, big, 0), (3, "http://c", None, 0), (4, "http://d", "small", 0), (5, "http://d", "small", 0), (None, "http://n", big, 0), (7, "u", other, 0), (7, "u", other, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    index = warc_index.write(df)
    got = sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_index.read(index).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert got == [(-1, 2000, sha(big), "revisit", 2), (1, 2000, sha(big), "revisit", 2), (2, 2000, sha(big), "response", None), (3, 0, sha(""), "response", None), (4, 5, sha("small"), "response", None), (5, 5, sha("small"), "response", None), (7, 1200, sha(other), "response", None), (7, 1200, sha(other), "response", None)]
    assert warc_index.read(index.where("page_id = 4")).count() == 1
    assert warc_index.read(warc_index.write(df.limit(0))).count() == 0


def placed(runs, counts, cap):
    """Every piece once, gapless, within the capacities; the number of sequences."""
    bins: dict[int, list] = {}
    for length in counts:
        own = sorted(r for r in runs if r[0] == length)
        rank = 0
        for _, first, n, start, each, offset in own:
            assert first == rank
            rank += n * each
            for k in range(n * each):
                bins.setdefault(start + k // each, []).append((offset + k % each * length, length))
        assert rank == counts[length]
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        need = np.array([at, len(items), sum(x * x for _, x in items)])
        assert (need <= cap.limits()).all()
    return len(bins)


def test_plan():
    r = random.Random(2)
    for cap in (vector_pack.Capacity(64), vector_pack.Capacity(64, documents=3), vector_pack.Capacity(64, attention=2500, score="dot", weights=(1, 1, 1)), vector_pack.Capacity(64, weights=(1, 0, 1))):
        for _ in range(20):
            counts = {length: r.randint(1, 30) for length in r.sample(range(1, 51), r.randint(1, 12))}
            assert placed(vector_pack.plan(counts, cap), counts, cap) >= -(-sum(k * v for k, v in counts.items()) // 64)


def test_pack(spark):
    df = docs(spark, ODD)
    got = vector_pack.pack(df, public_tokenizers.path("word_bpe_49k.json"), cap=vector_pack.Capacity(512)).collect()
    c, want = cached(SpaceFree, public_tokenizers.path("word_bpe_49k.json")), []
    for r in df.collect():
        ids = np.append(np.frombuffer(c.whole(r["text"] or ""), "<u2").astype("<u4"), np.uint32(0)).astype("<u4")
        want += [(r["doc_id"] or 0, k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for k, at in enumerate(range(0, len(ids), 512))]
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    total: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == total.get(r["sequence_id"], 0)
        total[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(total.values()) <= 512 and len(total) == -(-sum(w[3] for w in want) // 512)
    assert vector_pack.pack(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0
