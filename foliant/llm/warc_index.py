"""WARC archives read through an index.

Writing deals pages out, writes one gzip member a record, and returns an index row for each record: file, offset,
length, URL and digest. Reading starts from index rows, sorts them by file and offset, reads neighbouring byte ranges
together, and parses the records out of them.

Of records with equal payloads of at least ``least`` bytes, that with the largest page_id is a response and the others
are revisits of it, which carry the payload's digest and its length in their HTTP header but no payload.

Defined cases: null html counts as empty; a null URL leaves the target header out; null page_ids are kept, and revisit
if any equal payload has a page_id; rows that repeat a response's page_id and payload are responses too; no rows give
no archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, fresh_path, lookup, open_fs, pick

LEAST = 1000
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20  # most bytes of one coalesced read
GAP_BYTES = 64 << 10  # unwanted bytes that a coalesced read may pass over
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "path string, offset long, length long, page_id long, url string, digest string, record_type string"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; with refers_to a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers with lower-case names, HTTP header, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives pages (page_id, url, html); gives the index."""
    folder = fresh_path(pages.sparkSession, "warc")
    body = F.coalesce("html", F.lit(""))
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    big = F.octet_length("html") >= least
    groups = cut(rows.where(big).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "warc-groups")
    copies = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    known = lookup(rows, groups, "digest", ["first"], "copies", copies)
    refers = F.when(big & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    dealt = known.select("page_id", "url", "html", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        part, out, path, at, seq = TaskContext.get().partitionId(), None, "", 0, 0
        try:
            for b in batches:
                index = []
                for page, url, html, digest, refers_to in zip(*(b.column(k).to_pylist() for k in range(5))):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.warc.gz"
                        out, path, at, seq = fs.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, seq + 1
                    data = _gzip(record(page, url, html.encode("utf-8"), digest, refers_to))
                    out.write(data)
                    index.append((path, at, len(data), page, url, digest, "response" if refers_to is None else "revisit"))
                    at += len(data)
                cols = list(zip(*index)) if index else [[]] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return cut(dealt.mapInArrow(run, _INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that index rows name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: list[tuple[str, int, int]] = []
        for b in batches:
            wanted += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())
            if len(wanted) > 50_000:
                yield _records(wanted)
                wanted = []
        if wanted:
            yield _records(wanted)

    shards = F.floor(F.col("offset") / (4 * READ_BYTES))
    tasks = 2 * index.sparkSession.sparkContext.defaultParallelism
    return index.select("path", "offset", "length").repartition(tasks, "path", shards).sortWithinPartitions("path", "offset").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _records(wanted: list[tuple[str, int, int]]) -> pa.RecordBatch:
    out, k = [], 0
    while k < len(wanted):
        path, first, _ = wanted[k]
        end, last = first, k
        while last < len(wanted) and wanted[last][0] == path and wanted[last][1] <= end + GAP_BYTES and (last == k or wanted[last][1] + wanted[last][2] - first <= READ_BYTES):
            end = max(end, wanted[last][1] + wanted[last][2])
            last += 1
        fs, name = open_fs(path)
        with fs.open_input_file(name) as f:
            f.seek(first)
            data = f.read(end - first)
        for _, at, size in wanted[k:last]:
            fields, http, payload = parse(zlib.decompress(data[at - first : at - first + size], 31))
            number = lambda key: None if fields[key] == "<urn:page:null>" else int(fields[key][10:-1])
            digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
            length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
            if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
                raise ValueError(f"{path} at {at}: the payload differs from its digest")
            out.append((number("warc-record-id"), length, digest, kind, number("warc-refers-to") if kind == "revisit" else None))
        k = last
    cols = list(zip(*out))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
