"""WARC archives: writing with payload deduplication, and reading in parallel with boundary-chain verification.

Reading: archives are cut into blocks. A task finds what looks like a record's start in its block (the magic of a gzip member, or
WARC/1. for plain archives), works out each candidate's successor (where the member or the declared length ends), and follows these
to the first offset beyond the block. Pointer jumping from each file's start over these (file, offset, exit) rows marks the
offsets that the chain reaches; rounds are the logarithm of the blocks in a file. Then each reached block is read from its entry.
Magic inside payloads gives candidates that nothing reaches, so it never gives records.

Cases: null html is an empty payload; null url leaves out the target. Null page_id is kept as null, and counts as smallest when a
group's response is chosen. Rows that repeat the largest page_id of a group are all responses. Empty tables give empty results. A
record that the chain reaches but that can't be parsed raises an error: the archive is damaged.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_chunks, workdir
from .files import Ranges, Roll, blocks, rows_of

MAGIC = {True: re.compile(rb"\x1f\x8b\x08"), False: re.compile(rb"WARC/1\.[01]\r\n")}
LEAST = 1000  # bytes of a payload that others may refer to
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target string, path string, offset bigint"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that keeps the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response"]
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, first: of equal payloads of at least LEAST bytes, the largest page_id. Groups are found on digests alone; the pages then move once."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumns({"digest": F.sha1(data), "large": F.octet_length(data) >= LEAST})
    groups = rows.where("large").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(groups.hint("merge"), "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("large"), F.col("first")).alias("first"))


def write(pages: DataFrame, folder: str, compress: bool = True, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes the rows of with_references() as archives (a gzip member each record if compress). Returns the stored manifest: path, size."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, sizes = Roll(folder, ".warc.gz" if compress else ".warc", file_bytes), {}
        for chunk in text_chunks(batches, "html"):
            for page_id, url, html, digest, first in rows_of([chunk]):
                data = record(page_id, url, (html or "").encode(), digest, first, first is not None and first != page_id)
                if compress:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                path, at = roll.write(data)
                sizes[path] = at + len(data)
        roll.close()
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array([*sizes]), pa.array([*sizes.values()], pa.int64())], names=["path", "size"])

    return stored(pages.mapInArrow(put, "path string, size bigint"), "warc-manifest")


def _successor(file: Ranges, at: int, compressed: bool, step: int = 1 << 16) -> tuple[int, bytes]:
    """Where the record at an offset ends and what it has; -1 if there is none."""
    if compressed:
        z, out, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                if not (data := file.read(pos, step)):
                    return -1, b""
                out.append(z.decompress(data))
                pos += len(data)
                step = min(step * 4, 1 << 24)
        except zlib.error:
            return -1, b""
        return pos - len(z.unused_data), b"".join(out)
    data = file.read(at, step)
    while (end := data.find(b"\r\n\r\n")) < 0 and len(data) < 1 << 20 and at + len(data) < file.size:
        data += file.read(at + len(data), step)
    found = re.search(rb"\r\nContent-Length:\s*(\d+)", data[: end + 2], re.I) if end >= 0 else None
    size = end + 4 + int(found[1]) + 4 if found else 0
    if not found or at + size > file.size:
        return -1, b""
    return at + size, data[:size] if size <= len(data) else file.read(at, size)


def _exits(file: Ranges, first: int, last: int, compressed: bool) -> Iterator[tuple[int, int]]:
    """Candidates in a block, each with the first offset outside the block that its chain comes to, or -1."""
    data = file.read(first, last - first + 16)
    found = [first + m.start() for m in MAGIC[compressed].finditer(data) if first + m.start() < last]
    out: dict[int, int] = {}
    for at in reversed(found):
        end, _ = _successor(file, at, compressed)
        out[at] = end if end < 0 or end >= last else out.get(end, -1)
    yield from out.items()


def reached(links: DataFrame, rounds: int) -> DataFrame:
    """links: path, at, exit. The (path, at) that a chain from offset 0 comes to, by pointer jumping: each round doubles the way that links go."""
    marked = links.where("at = 0").select("path", "at")
    for _ in range(rounds):
        step = marked.join(links, ["path", "at"]).select("path", F.col("exit").alias("at"))
        marked = stored(marked.union(step.where("at >= 0")).distinct(), "warc-marked")
        onward = links.select("path", F.col("at").alias("exit"), F.col("exit").alias("to"))
        links = stored(links.join(onward, ["path", "exit"], "left").select("path", "at", F.coalesce("to", F.lit(-1)).alias("exit")), "warc-links")
    return marked.join(links.select("path", "at"), ["path", "at"], "left_semi") if not rounds else marked


def parse(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target of a record; a response's digest is worked out and held against its header."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    page = lambda uri: int(x) if (x := uri.removeprefix("<urn:page:").removesuffix(">")) else None
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "revisit":
        size, refers = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), page(fields["warc-refers-to"])
    else:
        size, refers = len(payload), None
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload doesn't match its digest")
    return page(fields["warc-record-id"]), size, digest, fields["warc-type"], refers, fields.get("warc-target-uri")


def read(files: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """The records of archives. files: path, size."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block in rows_of(batches):
            with Ranges(path) as file:
                got = [*_exits(file, block * block_bytes, min(file.size, (block + 1) * block_bytes), path.endswith(".gz"))]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(got)), pa.array([a for a, _ in got], pa.int64()), pa.array([e for _, e in got], pa.int64())], names=["path", "at", "exit"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, at in rows_of(batches):
            rows, held = [], 0
            with Ranges(path) as file:
                last = min(file.size, (at // block_bytes + 1) * block_bytes)
                while at < last:
                    end, data = _successor(file, at, path.endswith(".gz"))
                    if end < 0:
                        raise ValueError(f"{path}: the chain breaks at {at}")
                    rows.append((*parse(data), path, at))
                    at = end
                    if len(rows) >= 4096:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    links = stored(blocks(files, block_bytes).mapInArrow(candidates, "path string, at bigint, exit bigint"), "warc-links")
    largest = files.agg(F.max("size")).first()[0] or 0
    starts = reached(links, math.ceil(math.log2(max(1, math.ceil(largest / block_bytes)))))
    inside = starts.join(files, "path").where("at < size").select("path", "at")
    tasks = max(12, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return inside.repartition(tasks, "path", "at").mapInArrow(records, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORD.split(", ")])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op1 query: all pages written to archives and read back."""
    files = write(with_references(table(spark, sf_dir, "pages")), workdir(spark, "warc"))
    return read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM g
"""
