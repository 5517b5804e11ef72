"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and an end mark. Each token is coded as a chain of bits: does it occur after the two
words before it, after the one, earlier in this text, in the corpus at all? The first yes gives the level, and the token is
then one of the level's words, each as likely as it was counted there. A word that no level has is spelled in bytes:
steps down a Huffman tree and an end, each a bit.

Every bit is predicted by several predictors, each a pair of counts (no, yes) found by a hashed context; one more is the
share of yes so far at this level in this very text. Their log odds are mixed by logistic weights, which a gate selects by how
often the level's context was seen. An adaptive probability map refines the mixed odds, and counts kept within the text
refine them further while it is coded. The mixer learns online, block by block: predict, move weights and map, then
count. It learns from all training rows, each judged against the counts of all the others (its own occurrence is taken
off), so what it learns holds for texts that were not trained on.

What is gathered from the corpus grows with it: exact counts of all words, and counts of all hashed contexts of one and
two words with the word after them. Neither goes to the driver or to all tasks. Rows are dealt into chunks of about
CHUNK_BYTES, which are kept as word numbers; a chunk asks the shard of each of its words and contexts (the number of
shards follows the size of the corpus, and a shard tells 2**PLACE contexts apart), shards add up what the chunks have, and
answer each chunk. Questions of a chunk to one shard travel as one packed row; there are never more such rows than
distinct words and contexts of the chunks. Answers are kept in one file for GROUP chunks, whose name follows from the
chunk, so that a chunk finds its own without a join. Sent to all tasks are only the mixer and the byte model, of fixed size; sums of
them go up a tree. Words of one chunk are told apart by 64-bit hashes, words of the corpus by their bytes.

The probabilities of all texts add up to at most one: a lower level doesn't exclude the words of the levels above.

Defined cases: null text counts as empty, which is one end mark; null ids are trained on and scored; repeated rows are
kept; with nothing to train on, all counts are zero and the base score is that of an unseen token; extra columns are
ignored. A chunk, and so the longest text, is in memory whole, at about two hundred bytes a token.
"""

from __future__ import annotations

import functools
import heapq
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, drop_held, fresh_path, keep_memory, open_fs, pick, release, slices

CHUNK_BYTES = 8 << 20  # of text that ask together
GROUP = 16  # chunks whose answers are in one file
SHARD_BYTES = 12 << 20  # of text whose contexts one shard counts
PLACE = 36  # bits that tell contexts of a shard apart
ORDERS = 2  # words before, of the longest context
LEVELS = ORDERS + 2  # after 2 words, 1 word; in this text; in the corpus
TEXT, CORPUS, SPELLED, NONE = ORDERS, ORDERS + 1, ORDERS + 2, ORDERS + 3
SLOTS_BITS = 14  # of each predictor's table
INPUTS, GATES, MAP_STEPS = 4, 16, 33  # predictors by hashed context
BLOCK = 1 << 13  # bits after which the learner moves on
DELTA, RATE, START_WEIGHT = 0.4, 0.3, 0.3
TEXT_BINS, TEXT_PRIOR = 8, 24.0
BYTE_BITS, BYTE_ORDERS = 18, (1, 2, 4)
END, SPELL_END = b"", b"\n"  # neither is a word
FAN_IN = 16  # models added up at once
_U = np.uint64


_FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))  # white space to a space, A-Z to a-z


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, then the end mark."""
    return [*_bytes(text).translate(_FOLD).split(), END]


def is_training(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) != 1, F.lit(True))


# tokens of a chunk and their hashed contexts


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE_HASH = mix64(np.arange(64 * 256, dtype=np.uint64) + _U(0x9E3779B97F4A7C15))
_BYTE_HASH[32::256] = 0  # a space is in no word


def _words_in(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of text whose white space is spaces.

    A word's hash is the sum of hashes of its bytes at their places (in turns of 64), mixed with its length.
    """
    out, at = [], 0
    while at < len(data):
        upto = data.rfind(b" ", at, at + (1 << 20)) + 1 if len(data) - at > 1 << 20 else len(data)
        upto = upto or data.find(b" ", at) + 1 or len(data)
        a = np.frombuffer(data, dtype=np.uint8, count=upto - at, offset=at)
        inside = a != 32
        step = np.diff(inside.view(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(start):
            place = np.zeros(len(a), dtype=np.int32)
            place[start[0] :] = np.arange(start[0], len(a), dtype=np.int32) - np.repeat(start.astype(np.int32), np.diff(np.append(start, len(a))))
            part = _BYTE_HASH[((place & 63) << 8) | a]
            far = np.flatnonzero(place > 63)
            part[far] *= (2 * (place[far] >> 6) + 1).astype(np.uint64)
            h = np.add.reduceat(part, start)
            out.append((mix64(h + (end - start).astype(np.uint64)), start + at, end + at))
        at = upto
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _same_together(h: np.ndarray) -> np.ndarray:
    """An order in which equal hashes stand together: by their high bits, and by all where those of two are alike."""
    room = max(1, len(h) - 1).bit_length()
    both = (h >> _U(room) << _U(room)) | np.arange(len(h), dtype=np.uint64)
    both.sort()
    order = (both & _U((1 << room) - 1)).astype(np.int64)
    high, full = both >> _U(room), h[order]
    return order if np.array_equal(high[1:] != high[:-1], full[1:] != full[:-1]) else np.argsort(h)


_END_HASH = mix64(np.array([1], dtype=np.uint64))


@dataclass
class Tokens:
    """Texts one after another as word numbers; a text ends with word 0, the end mark. Frequent words have low numbers."""

    blob: bytes  # the words from the second on, with SPELL_END between them
    hashes: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    bytes: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        raw = [_bytes(t) for t in texts]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        data = b" ".join(raw).translate(_FOLD)
        del raw
        h, start, end = _words_in(data)
        order = _same_together(h)
        first, at = _distinct(h[order])
        n = np.diff(np.append(at, len(h)))
        rank = np.empty(len(first), np.int32)
        common = np.argsort(-n, kind="stable")
        rank[common] = np.arange(1, len(first) + 1)
        number = np.empty(len(h), np.int32)
        number[order] = np.repeat(rank, n)
        some = order[at[common]]
        size = end[some] - start[some] + 1
        place = np.arange(int(size.sum())) + np.repeat(start[some] - (np.cumsum(size) - size), size)
        letters = np.frombuffer(data + b" ", dtype=np.uint8)[place]
        letters[np.cumsum(size) - 1] = SPELL_END[0]
        blob = letters.tobytes()[:-1]
        lengths = np.diff(np.searchsorted(start, np.cumsum(sizes + 1)), prepend=0) + 1
        ids = np.zeros(len(h) + len(texts), np.int32)
        ends = np.cumsum(lengths) - 1
        keep = np.ones(len(ids), bool)
        keep[ends] = False
        ids[keep] = number
        return cls.numbered(blob, np.concatenate((_END_HASH, first[common])), ids, lengths, sizes)

    @classmethod
    def numbered(cls, blob: bytes, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> Tokens:
        return cls(blob, hashes, ids, np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths), sizes)

    def pack(self) -> tuple[bytes, bytes, list[int], list[int]]:
        """(words, numbers, lengths, sizes) as they are kept."""
        planes = np.ascontiguousarray(self.ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        lengths = np.diff(np.append(self.starts, len(self.ids)))
        return zlib.compress(self.blob, 1), zlib.compress(planes.tobytes(), 1), lengths.tolist(), self.bytes.tolist()

    @classmethod
    def unpack(cls, words: bytes, numbers: bytes, lengths, sizes) -> Tokens:
        blob = zlib.decompress(words)
        hashes = np.concatenate((_END_HASH, _words_in(blob.replace(SPELL_END, b" "))[0]))
        ids = np.ascontiguousarray(np.frombuffer(zlib.decompress(numbers), dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int32)
        return cls.numbered(blob, hashes, ids, np.asarray(lengths, dtype=np.int64), np.asarray(sizes, dtype=np.int64))

    @functools.cached_property
    def words(self) -> list[bytes]:
        return [END, *(self.blob.split(SPELL_END) if self.blob else [])]

    def before(self) -> list[np.ndarray]:
        """Hashes of the words one and two before each token; those before a text are zero."""
        out, last = [], self.hashes[self.ids]
        for _ in range(ORDERS):
            last = np.concatenate((np.zeros(1, np.uint64), last[:-1]))
            last[self.starts] = 0
            out.append(last)
        return out

    def contexts(self, shards: int) -> list[np.ndarray]:
        """For 1 and 2 words before: each token's place, shard * 2**PLACE + slot, by a hash of those words and its own."""
        out, h = [], self.hashes[self.ids]
        for k, last in enumerate(self.before()):
            h = mix64(h * _U(0x9E3779B97F4A7C15) + mix64(last + _U(k + 1)))
            out.append(places(h, shards))
        return out

    def word_order(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers by shard and hash, shard of each)."""
        order = np.argsort(self.hashes, kind="stable")
        return order, (places(self.hashes[order], shards) >> _U(PLACE)).astype(np.int64)


def places(h: np.ndarray, shards: int) -> np.ndarray:
    """h * shards / 2**64: the whole part, which is the shard, above PLACE bits of the rest."""
    s = _U(shards)
    shard = ((h >> _U(32)) * s + (((h & _U(0xFFFFFFFF)) * s) >> _U(32))) >> _U(32)
    return (shard << _U(PLACE)) | ((h * s) >> _U(64 - PLACE))


def _pack_places(x: np.ndarray) -> bytes:
    """Sorted places of one shard as steps; the two low bytes of a step don't compress, the others do."""
    steps = np.diff(x, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps[:, :2].tobytes() + zlib.compress(np.ascontiguousarray(steps[:, 2:5].T).tobytes(), 1)


def _unpack_places(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[:, :2] = np.frombuffer(data, dtype=np.uint8, count=2 * n).reshape(n, 2)
    steps[:, 2:5] = np.frombuffer(zlib.decompress(data[2 * n :]), dtype=np.uint8).reshape(3, n).T
    return np.cumsum(steps.view("<u8").reshape(-1))


def _order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, their places before), equal keys in order. bits: of the largest key."""
    room = max(1, len(key) - 1).bit_length()
    if bits + room > 64:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = (key.astype(np.uint64) << _U(room)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return both >> _U(room), (both & _U((1 << room) - 1)).astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Counts, compressed, as the narrowest unsigned numbers that hold them."""
    most = int(x.max()) if len(x) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(k[2]))
    return kind[2].encode() + zlib.compress(x.astype(kind).tobytes(), 1)


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype="<u" + chr(data[0])).astype(np.int64)


# questions and answers


CHUNK = "chunk long, doc_ids array<long>, train array<boolean>, words binary, numbers binary, lengths array<long>, sizes array<long>"


def chunked(docs: DataFrame) -> DataFrame:
    """Rows dealt into chunks of about CHUNK_BYTES as they come, and written: one row a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        keep_memory()
        part, seq = TaskContext.get().partitionId() << 32, 0
        ids, texts, train, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            t = Tokens.of(texts)
            words, numbers, lengths, sizes = t.pack()
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            cols = [pa.array([x], k) for x, k in zip((part + seq, ids, train, words, numbers, lengths, sizes), kinds)]
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "doc_ids", "train", "words", "numbers", "lengths", "sizes"])

        for b in slices(batches, 1):
            ids += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
            train += b.column(2).to_pylist()
            size += pc.sum(pc.binary_length(b.column(1))).as_py() or 0
            if size >= CHUNK_BYTES:
                yield close()
                ids, texts, train, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield close()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), is_training().alias("train"))
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "mix-chunks")
    rows.mapInArrow(run, CHUNK).write.option("parquet.block.size", 16 << 20).parquet(path)  # a chunk's row is some megabytes
    return spark.read.schema(CHUNK).parquet(path)


def tokens_of(row: dict) -> Tokens:
    return Tokens.unpack(row["words"], row["numbers"], row["lengths"], row["sizes"])


def questions(chunks: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, keys, counts): what chunks have for each shard. Shards below ``shards`` hold contexts, the others words."""

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        t = tokens_of(row)
        own = np.array(row["train"], dtype=np.uint64)[t.doc]
        q = np.concatenate([(p << _U(1)) | own for p in t.contexts(shards)])
        q.sort()
        place, first = _distinct(q >> _U(1))
        counts = np.add.reduceat((q & _U(1)).astype(np.int64), first)
        slot, at = place & _U((1 << PLACE) - 1), np.searchsorted(place, np.arange(shards + 1, dtype=np.uint64) << _U(PLACE))
        rows = [(s, _pack_places(slot[a:b]), _small(counts[a:b])) for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if b > a]
        order, shard = t.word_order(shards)
        seen = np.bincount(t.ids[own == 1], minlength=len(t.hashes))[order]
        at = np.searchsorted(shard, np.arange(shards + 1))
        words = [t.words[k] for k in order.tolist()]
        rows += [(shards + s, SPELL_END.join(words[a:b]), _small(seen[a:b])) for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if b > a]
        for k in range(0, len(rows), 500):
            part = rows[k : k + 500]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([row["chunk"]] * len(part), pa.int64()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.binary())], names=["shard", "chunk", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        keep_memory()
        for b in batches:
            for k in range(b.num_rows):
                yield from ask(b.slice(k, 1).to_pylist()[0])
        release()

    return chunks.mapInArrow(run, "shard long, chunk long, keys binary, counts binary")


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, index of the first of each) of a sorted array."""
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    return x[first], first


def answers(asked: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, counts, stats): the corpus's counts of what a chunk asked; chunk null: a shard's totals n, v, ends, letters."""

    def contexts(chunks: list[int], keys: list[bytes], counts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        place, order = _order(np.concatenate([_unpack_places(k, len(n)) for k, n in zip(keys, counts)]), PLACE)
        _, first = _distinct(place)
        total = np.add.reduceat(np.concatenate(counts)[order], first)
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(total, np.diff(np.append(first, len(order))))
        yield from zip(chunks, np.split(back, np.cumsum([len(n) for n in counts])[:-1]))

    def words(chunks: list[int], keys: list[bytes], counts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        total: dict[bytes, int] = {}
        mine = [k.split(SPELL_END) for k in keys]
        for own, n in zip(mine, counts):
            for w, m in zip(own, n.tolist()):
                total[w] = total.get(w, 0) + m
        for c, own in zip(chunks, mine):
            yield c, np.fromiter(map(total.__getitem__, own), dtype=np.int64, count=len(own))
        seen = [w for w, n in total.items() if n]
        letters = np.bincount(np.frombuffer(b"".join([w + SPELL_END for w in seen]), dtype=np.uint8), minlength=256)
        yield None, np.concatenate(([sum(total.values()), len(seen), total.get(END, 0)], letters))

    def run(group: pa.Table) -> pa.Table:
        keep_memory()
        shard = group["shard"][0].as_py()
        chunks, keys, counts = group["chunk"].to_pylist(), group["keys"].to_pylist(), [_wide(x) for x in group["counts"].to_pylist()]
        out = list((contexts if shard < shards else words)(chunks, keys, counts))
        stats = [x.tolist() if c is None else None for c, x in out]
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "shard": pa.array([shard] * len(out), pa.int64()), "counts": pa.array([None if c is None else _small(x) for c, x in out], pa.binary()), "stats": pa.array(stats, pa.list_(pa.int64()))})

    return asked.groupBy("shard").applyInArrow(run, "chunk long, shard long, counts binary, stats array<long>")


def _group_path(folder: str, chunk: int) -> str:
    return f"{folder}/{chunk // GROUP:x}.answers"


def filed(told: DataFrame) -> tuple[str, DataFrame]:
    """Writes answers to files, one for GROUP chunks; gives their folder and the totals (stats).

    A file is written under a name of its own and moved into place; a task that runs again writes the same file.
    """
    spark = told.sparkSession
    folder = fresh_path(spark, "mix-answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        group, parts, index, at = None, [], [], 0

        def close() -> None:
            temporary = f"{base}/{uuid.uuid4().hex}.part"
            tail = np.array(index, dtype="<i8").tobytes()
            with fs.open_output_stream(temporary, compression=None) as f:
                for p in parts:
                    f.write(p)
                f.write(tail + np.array([len(index)], dtype="<i8").tobytes())
            try:
                fs.move(temporary, _group_path(base, group * GROUP))
            except OSError:  # where a file system doesn't replace: another attempt of this task has written the same
                if fs.get_file_info(_group_path(base, group * GROUP)).type == FileType.NotFound:
                    raise
                fs.delete_file(temporary)

        for b in batches:
            stats = []
            for c, s, data, own in zip(*(b.column(k).to_pylist() for k in range(4))):
                if c is None:
                    stats.append(own)
                    continue
                if group is not None and c // GROUP != group:
                    close()
                    parts, index, at = [], [], 0
                group = c // GROUP
                parts.append(data)
                index.append((c, s, at, len(data)))
                at += len(data)
            if stats:
                yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.int64()))], names=["stats"])
        if group is not None:
            close()
        release()

    group = F.floor(F.col("chunk") / GROUP)
    tasks = 2 * spark.sparkContext.defaultParallelism
    dealt = told.repartition(tasks, F.coalesce(group, F.xxhash64("shard"))).sortWithinPartitions("chunk", "shard")
    return folder, cut(dealt.mapInArrow(run, "stats array<long>"), "mix-stats")


def answers_of(folder: str, chunk: int) -> list[tuple[int, bytes]]:
    """(shard, counts) of the answers to a chunk, in order of shard."""
    fs, path = open_fs(_group_path(folder, chunk))
    with fs.open_input_file(path) as f:
        end = f.size()
        f.seek(end - 8)
        n = int(np.frombuffer(f.read(8), dtype="<i8")[0])
        f.seek(end - 8 - 32 * n)
        index = np.frombuffer(f.read(32 * n), dtype="<i8").reshape(n, 4)
        own = index[index[:, 0] == chunk].tolist()
        if not own:
            raise ValueError(f"no answers to chunk {chunk}")
        first = own[0][2]
        f.seek(first)
        data = f.read(own[-1][2] + own[-1][3] - first)
    return [(s, data[at - first : at - first + size]) for _, s, at, size in own]


# bits


@dataclass
class Bits:
    """The bits of one level: which tokens pass it, what they say, and what predicts them."""

    token: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]
    gate: np.ndarray
    doc: np.ndarray
    yes: np.ndarray  # of this level so far in the text
    so_far: np.ndarray


@dataclass
class Chain:
    """Levels of a chunk's tokens, and the log probability of each token within its level (spelled ones: zero)."""

    level: np.ndarray
    choice: np.ndarray
    bits: list[Bits] = field(default_factory=list)


def _runs(key: np.ndarray, bits: int, value: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(how many, sum of values) among the earlier elements with the same key. bits: of the largest key."""
    k, order = _order(key, bits)
    _, first = _distinct(k)
    size = np.diff(np.append(first, len(k)))
    out = np.empty(len(k), np.int64)
    out[order] = np.arange(len(k)) - np.repeat(first, size)
    if value is None:
        return out, None
    v = value[order]
    total = np.cumsum(v) - v
    total -= np.repeat(total[first], size)
    sums = np.empty(len(k), np.int64)
    sums[order] = total
    return out, sums


def _runs_of_texts(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same within texts, whose numbers don't fall."""
    _, first = _distinct(doc)
    size = np.diff(np.append(first, len(doc)))
    total = np.cumsum(value) - value
    return np.arange(len(doc)) - np.repeat(first, size), total - np.repeat(total[first], size)


def _log2(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n.astype(np.float64) + 1)[1] - 1, GATES - 1)


def chain(t: Tokens, word_counts: np.ndarray, context_counts: list[np.ndarray], total: int, docs: int, own: np.ndarray) -> Chain:
    """Codes tokens as bits, given counts of words and of the contexts of 1 and 2 words. own: 1 for a token whose text
    is among those counted and is to be judged by the others, else 0."""
    c0 = word_counts[t.ids] - own
    counts = [c - own for c in context_counts]
    seen = []  # how often the context was seen
    for k in range(ORDERS):
        below = word_counts[t.ids] if k == 0 else context_counts[k - 1]
        s = np.concatenate((np.zeros(1, np.int64), below[:-1]))
        s[t.starts] = docs
        seen.append(s - own)
        counts[k] = np.minimum(counts[k], seen[k])  # where two contexts share a place
    at = np.arange(len(t.ids)) - t.starts[t.doc]
    before, _ = _runs(t.doc * len(t.hashes) + t.ids, (len(t.starts) * len(t.hashes)).bit_length())
    level = np.full(len(t.ids), SPELLED)
    level[c0 > 0] = CORPUS
    level[before > 0] = TEXT
    for k in range(ORDERS):
        level[counts[k] > 0] = ORDERS - 1 - k
    choice = np.zeros(len(t.ids))
    for lev, have, of in [*[(ORDERS - 1 - k, counts[k], seen[k]) for k in range(ORDERS)], (TEXT, before, at), (CORPUS, c0, total - own)]:
        own_level = np.flatnonzero(level == lev)
        choice[own_level] = np.log(have[own_level] / (of[own_level] if isinstance(of, np.ndarray) else of))
    last = []
    shifted = level
    for _ in range(4):
        shifted = np.concatenate(([NONE], shifted[:-1]))
        shifted[t.starts] = NONE
        last.append(shifted)
    some = [s > 0 for s in (*seen, at)]
    sizes = [_log2(s) for s in seen]
    size_text = _log2(at)
    del seen, counts, c0, before, at  # before the bits are made
    word = (mix64(t.before()[0]) >> _U(64 - SLOTS_BITS)).astype(np.int64)
    pair = last[0] * 7 + last[1]
    past = (pair * 7 + last[2]) * 7 + last[3]
    both = (sizes[1] * 16 + sizes[0]) * 16 + np.minimum(size_text, 15)
    out = Chain(level, choice)
    for lev in range(LEVELS):
        have = sizes[ORDERS - 1 - lev] if lev < ORDERS else size_text
        passes = level >= lev
        if lev < ORDERS:
            passes &= some[ORDERS - 1 - lev]
        elif lev == TEXT:
            passes &= some[ORDERS]
        sel = np.flatnonzero(passes)
        bit = (level[sel] == lev).astype(np.int64)
        doc = t.doc[sel]
        so_far, yes = _runs_of_texts(doc, bit)
        gate = have[sel]
        out.bits.append(Bits(sel, bit, [gate * 49 + pair[sel], word[sel], both[sel], past[sel]], gate, doc, yes, so_far))
    return out


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 1 / (1 + np.exp(-x))


_CENTRE = np.linspace(-12, 12, MAP_STEPS)


def text_bin(logit: np.ndarray) -> np.ndarray:
    return np.clip((logit + 4).astype(np.int64), 0, TEXT_BINS - 1)


class Learner:
    """One kind of bit: predictors' counts, weights by gate, the probability map."""

    def __init__(self, inputs: int, slots: int, gates: int, extra: int):
        self.counts = np.zeros((inputs, slots, 2), dtype=np.float32)  # whole numbers; a chunk has fewer than 2**24 bits of one kind
        self.weights = np.full((gates, inputs + extra), START_WEIGHT)
        self.map = np.zeros((gates, MAP_STEPS, 2))
        self.seen = 0.0
        self.total: np.ndarray | None = None  # the counts of all chunks
        self.known: np.ndarray | None = None  # log odds by slot, once nothing more is counted

    def freeze(self) -> None:
        n = self.total if self.total is not None else self.counts
        self.known = np.log((n[:, :, 1] + DELTA) / (n[:, :, 0] + DELTA)).astype(np.float32)

    def inputs(self, slots: list[np.ndarray], extra: list[np.ndarray]) -> np.ndarray:
        x = np.empty((self.weights.shape[1], len(slots[0])), np.float32)
        for k, s in enumerate(slots):
            if self.known is not None:
                x[k] = np.take(self.known[k], s)
            else:
                n = np.take(self.counts[k].view(np.complex64)[:, 0], s)  # a pair at once
                x[k] = np.log((n.imag + np.float32(DELTA)) / (n.real + np.float32(DELTA)))
        for k, e in enumerate(extra):
            x[len(slots) + k] = e
        return x

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        total = np.zeros(len(gate))
        for k, own in enumerate(np.ascontiguousarray(self.weights.T)):
            total += np.take(own, gate) * x[k]
        return np.clip(total, -12, 12, out=total)

    def refined(self, logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mean of the mixed log odds and the map's."""
        pseudo = squash(_CENTRE)
        odds = np.log((self.map[:, :, 1] + 4 * pseudo) / (self.map[:, :, 0] + 4 * (1 - pseudo)))
        return (logit + odds[gate, np.rint((logit + 12) * ((MAP_STEPS - 1) / 24)).astype(np.int64)]) / 2

    def learn(self, slots: list[np.ndarray], extra: list[np.ndarray], gate: np.ndarray, bit: np.ndarray) -> None:
        """Blocks in order, the first ones small so that a small table too corrects on counts: predict, correct weights and map, count."""
        at, size = 0, 256
        while at < len(bit):
            part = slice(at, at + size)
            s, g, b = [x[part] for x in slots], gate[part], bit[part]
            x = self.inputs(s, [e[part] for e in extra])
            logit = self.mixed(x, g)
            error = b - squash(logit)
            n = np.bincount(g, minlength=len(self.weights))
            step = RATE * np.minimum(1, n / 100) / np.maximum(n, 1)
            for k in range(len(x)):
                self.weights[:, k] = np.clip(self.weights[:, k] + step * np.bincount(g, weights=error * x[k], minlength=len(n)), -1, 2)
            cell = (g * MAP_STEPS + np.rint((logit + 12) * ((MAP_STEPS - 1) / 24)).astype(np.int64)) * 2 + b
            self.map += np.bincount(cell, minlength=self.map.size).reshape(self.map.shape)
            for k, own in enumerate(s):
                np.add.at(self.counts[k].reshape(-1), own * 2 + b, np.float32(1))
            self.seen += len(b)
            at, size = at + size, min(BLOCK, size * 2)


class Model:
    """The learners of the levels and of spelling."""

    def __init__(self):
        self.levels = [Learner(INPUTS, 1 << SLOTS_BITS, GATES, 2) for _ in range(LEVELS)]
        self.bytes = Learner(len(BYTE_ORDERS), 1 << BYTE_BITS, GATES, 1)

    def learners(self) -> list[Learner]:
        return [*self.levels, self.bytes]

    def pack(self) -> np.ndarray:
        """One array that can be added up: weights count by the bits they have seen."""
        return np.concatenate([a.ravel() for m in self.learners() for a in (m.counts, m.map, m.weights * m.seen, np.array([m.seen]))])

    @classmethod
    def unpack(cls, data: np.ndarray) -> Model:
        out, at = cls(), 0
        for m in out.learners():
            m.total = np.zeros(m.counts.shape)
            for a in (m.total, m.map, m.weights):
                if a is not m.weights:
                    a[...] = data[at : at + a.size].reshape(a.shape)
                else:
                    m.seen = float(data[at + a.size])
                    if m.seen:
                        a[...] = data[at : at + a.size].reshape(a.shape) / m.seen
                at += a.size
            at += 1
        return out

    @staticmethod
    def extra(b: Bits) -> list[np.ndarray]:
        """Predictors without a table: the share of yes in this text, trusted as it grows, and a constant."""
        return [stretch((b.yes + 1) / (b.so_far + 2)) * np.minimum(1, b.so_far / 16), np.full(len(b.bit), 0.5)]

    def learn(self, c: Chain) -> None:
        for m, b in zip(self.levels, c.bits):
            m.learn(b.slots, self.extra(b), b.gate, b.bit)

    def odds(self, lev: int, b: Bits) -> np.ndarray:
        """Log odds of yes for a level's bits, after mixing, map and the counts within the text."""
        m, parts, extra = self.levels[lev], [], self.extra(b)
        for at in range(0, len(b.bit), 1 << 16):
            part = slice(at, at + (1 << 16))
            parts.append(m.refined(m.mixed(m.inputs([s[part] for s in b.slots], [e[part] for e in extra]), b.gate[part]), b.gate[part]))
        logit = np.concatenate(parts) if parts else np.zeros(0)
        n, yes = _runs(b.doc * TEXT_BINS + text_bin(logit), (TEXT_BINS * (int(b.doc[-1]) + 1) if len(b.doc) else 1).bit_length(), b.bit)
        return stretch(np.clip((yes + TEXT_PRIOR * squash(logit)) / (n + TEXT_PRIOR), 1e-6, 1 - 1e-6))

    def cost(self, c: Chain) -> np.ndarray:
        """Natural-log cost of each token, without spelling."""
        out = -c.choice
        for lev, b in enumerate(c.bits):
            z = self.odds(lev, b)
            out[b.token] += np.log1p(np.exp(np.where(b.bit == 1, -z, z)))
        return out


# spelling


def huffman(counts: list[int]) -> list[str]:
    """Code words, as strings of 0 and 1, of symbols with these counts."""
    heap = [(c, k, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    fresh = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    codes, todo = [""] * len(counts), [(heap[0][2], "")]
    while todo:
        node, code = todo.pop()
        if node < len(counts):
            codes[node] = code
        else:
            todo += [(children[node][0], code + "0"), (children[node][1], code + "1")]
    return codes


class Tree:
    """For each byte the nodes that its code passes and the bits taken there, as flat arrays."""

    def __init__(self, counts: list[int]):
        codes = huffman([max(1, c) for c in counts])
        self.length = np.array([len(c) for c in codes])
        self.start = np.cumsum(self.length) - self.length
        names: dict[str, int] = {}
        self.node = np.array([names.setdefault(c[:k], len(names)) for c in codes for k in range(len(c))], dtype=np.uint64)
        self.bit = np.array([int(b) for c in codes for b in c])

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol position, node, bit) of every step of the symbols' codes."""
        n = self.length[symbols]
        at = np.arange(int(n.sum())) + np.repeat(self.start[symbols] - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(symbols)), n), self.node[at], self.bit[at]


def spelling(tree: Tree, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(word number, slots, gate, bit) of every step of the words' bytes and their ends."""
    data = np.frombuffer(b"".join([w + SPELL_END for w in words]), dtype=np.uint8).astype(np.int64)
    lengths = np.array([len(w) + 1 for w in words])
    word = np.repeat(np.arange(len(words)), lengths)
    pos = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner, node, bit = tree.steps(data)
    hashed, slots = np.zeros(len(data), np.uint64), []
    for k in range(1, max(BYTE_ORDERS) + 1):
        last = np.where(pos >= k, np.concatenate((np.zeros(k, np.int64), data[:-k]))[: len(data)] + 1, 0).astype(np.uint64)
        hashed = hashed * _U(0x100000001B3) + last + _U(k)
        if k in BYTE_ORDERS:
            h = (hashed[owner] + node * _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93)
            slots.append(((h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) >> _U(64 - BYTE_BITS)).astype(np.int64))
    return word[owner], slots, np.minimum(pos[owner], GATES - 1), bit


def learn_spelling(m: Learner, tree: Tree, words: list[bytes]) -> None:
    for k in range(0, len(words), 10_000):
        _, slots, gate, bit = spelling(tree, words[k : k + 10_000])
        m.learn(slots, [np.full(len(bit), 0.5)], gate, bit)


def spelling_cost(m: Learner, tree: Tree, words: list[bytes]) -> np.ndarray:
    """Natural-log cost of each word's bytes and its end."""
    out = []
    for k in range(0, len(words), 10_000):
        part = words[k : k + 10_000]
        word, slots, gate, bit = spelling(tree, part)
        z = m.refined(m.mixed(m.inputs(slots, [np.full(len(bit), 0.5)]), gate), gate)
        out.append(np.bincount(word, weights=np.log1p(np.exp(np.where(bit == 1, -z, z))), minlength=len(part)))
    return np.concatenate(out) if out else np.zeros(0)


# fitting and scoring


@dataclass(frozen=True)
class Corpus:
    """Training tokens, distinct ones, texts, and how often each byte is in the distinct words."""

    n: int
    v: int
    ends: int
    letters: tuple[int, ...]


def known_counts(t: Tokens, told: list[tuple[int, bytes]], shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The corpus's counts of a chunk's words and contexts, from the answers to the chunk."""
    empty = [np.zeros(0, np.int64)]
    of_contexts = np.concatenate([_wide(x) for s, x in told if s < shards] or empty)
    of_words = np.concatenate([_wide(x) for s, x in told if s >= shards] or empty)
    place, order = _order(np.concatenate(t.contexts(shards)), PLACE + shards.bit_length())
    _, first = _distinct(place)
    by_word, _ = t.word_order(shards)
    if len(of_contexts) != len(first) or len(of_words) != len(by_word):
        raise ValueError("the answers don't fit the chunk's questions")
    words, contexts = np.empty(len(by_word), np.int64), np.empty(len(order), np.int64)
    words[by_word] = of_words
    contexts[order] = np.repeat(of_contexts, np.diff(np.append(first, len(order))))
    return words, np.split(contexts, ORDERS)


def fit(chunks: DataFrame, folder: str, shards: int, corpus: Corpus) -> Model:
    """Learns from all training rows; what comes back is one model of fixed size."""

    def learned(row: dict) -> bytes:
        t = tokens_of(row)
        words, contexts = known_counts(t, answers_of(folder, row["chunk"]), shards)
        model = Model()
        own = np.array(row["train"], dtype=np.int64)[t.doc]
        c = chain(t, words, contexts, corpus.n, corpus.ends, own)
        for b in c.bits:
            keep = own[b.token] == 1
            b.token, b.bit, b.slots, b.gate, b.doc, b.yes, b.so_far = b.token[keep], b.bit[keep], [s[keep] for s in b.slots], b.gate[keep], b.doc[keep], b.yes[keep], b.so_far[keep]
        model.learn(c)
        del c
        # a word counted once is new to all other texts
        new = [t.words[k] for k in np.flatnonzero((words == 1) & (np.bincount(t.ids[own == 1], minlength=len(words)) > 0)).tolist() if k]
        learn_spelling(model.bytes, Tree(list(corpus.letters)), sorted(new))
        return zlib.compress(model.pack().tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        keep_memory()
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([learned(row)], pa.binary())], names=["deal", "data"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, total = None, None
        for b in batches:
            for k in range(b.num_rows):
                own = np.frombuffer(zlib.decompress(b.column(1)[k].as_py()), dtype=np.float64)
                deal, total = b.column(0)[k].as_py(), own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([deal], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["deal", "data"])

    summed = cut(chunks.mapInArrow(run, "deal long, data binary"), "mix-models")
    count, seed = summed.count(), 0
    while count > 1:  # a tree of sums, in which no task reads more than about FAN_IN models, however many there are
        most, seed = -(-count // FAN_IN), seed + 1
        deal = F.pmod(F.xxhash64("deal", F.lit(seed)), F.lit(most))  # so many deals at most, in however many partitions
        summed = cut(summed.withColumn("deal", deal).repartition(most, "deal").mapInArrow(add, "deal long, data binary"), "mix-models")
        count = summed.count()
    row = summed.first()
    return Model() if row is None else Model.unpack(np.frombuffer(zlib.decompress(row["data"]), dtype=np.float64))


@dataclass(frozen=True)
class Learned:
    """Chunks of rows, the folder of the answers to them, and what was learned from the training rows."""

    chunks: DataFrame
    folder: str
    shards: int
    corpus: Corpus
    model: Model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Learned:
    chunks = chunked(pick(docs, id_col, text_col).toDF("doc_id", "text"))
    size = chunks.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    folder, totals = filed(answers(questions(chunks, shards), shards))
    sums = {r["k"]: r["x"] for r in totals.select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()}  # 259 rows
    corpus = Corpus(sums.get(0, 0), sums.get(1, 0), sums.get(2, 0), tuple(sums.get(k + 3, 0) for k in range(256)))
    return Learned(chunks, folder, shards, corpus, fit(chunks, folder, shards, corpus))


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    learned = learn(docs, id_col, text_col)
    folder, shards, corpus = learned.folder, learned.shards, learned.corpus
    sent = docs.sparkSession.sparkContext.broadcast(learned.model)  # of fixed size
    floor, below = float(np.log10(0.5 / (corpus.n + 0.5 * (corpus.v + 1)))), float(np.log10(corpus.n + 0.5 * (corpus.v + 1)))

    def scored(row: dict) -> pa.RecordBatch:
        t = tokens_of(row)
        words, contexts = known_counts(t, answers_of(folder, row["chunk"]), shards)
        cost = total_cost(frozen(sent.value), Tree(list(corpus.letters)), t, words, contexts, corpus)
        base = np.where(words > 0, np.log10(words + 0.5) - below, floor)[t.ids]
        n = len(t.starts)
        sums = lambda x: np.bincount(t.doc, weights=x, minlength=n)
        nats, known = sums(cost), np.bincount(t.doc[words[t.ids] > 0], minlength=n)
        cols = [
            pa.array(row["doc_ids"], pa.int64()), pa.array([not x for x in row["train"]]), pa.array(np.bincount(t.doc, minlength=n), pa.int64()), pa.array(known, pa.int64()),
            pa.array([corpus.n] * n, pa.int64()), pa.array(sums(base)), pa.array(-nats / np.log(10)), pa.array(nats / np.log(2) / np.maximum(1, t.bytes)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        keep_memory()
        for b in batches:
            for k in range(b.num_rows):
                yield scored(b.slice(k, 1).to_pylist()[0])
        release()

    return learned.chunks.mapInArrow(run, OUT)


def frozen(m: Model) -> Model:
    """The model with its tables turned into log odds, once a worker."""
    if m.bytes.known is None:
        for x in m.learners():
            x.freeze()
    return m


def total_cost(model: Model, tree: Tree, t: Tokens, words: np.ndarray, contexts: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """Natural-log cost of each token, spelling included."""
    c = chain(t, words, contexts, corpus.n, corpus.ends, np.zeros(len(t.ids), np.int64))
    cost = model.cost(c)
    new = np.flatnonzero(words == 0)
    spelt = np.zeros(len(words))
    spelt[new] = spelling_cost(model.bytes, tree, [t.words[k] for k in new.tolist()])
    at = np.flatnonzero(c.level == SPELLED)
    cost[at] += spelt[t.ids[at]]
    return cost
