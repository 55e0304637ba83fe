"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by page, so each task writes a stretch of pages in order. A task rolls to the next file when the
compressed size is reached. Headers, record ids and digests follow from the record alone, so a task that runs again writes the
same bytes. A file is written under a temporary name and renamed when it is whole; the manifest, which the job commits last, says
which files count. The reader reads what the manifest lists and checks every digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 128 << 20  # compressed size at which a file is closed
RANGE_BYTES = 512 << 20  # payload of a sort range, about
REVISIT_BYTES = 1000  # equal payloads of this size or more are stored once
DATE = "2024-01-01T00:00:00Z"  # of every record; fixed, so that the bytes are
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _uri(url: str | None) -> str:
    """A header value on one line; characters that can't stand there are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as f:
        f.write(data)
    return out.getvalue()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:", folder) else (fs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> None:
    """Writes a record for every row of ``pages`` (page_id, url, html) to ``folder``, a new folder that all executors reach.

    A NULL html is an empty payload. Of rows with equal payloads of ``REVISIT_BYTES`` or more, those with the largest page_id are
    responses and the others revisits of it; repeated rows with that id are all responses, as is every row where no id is known.
    No pages make no archives and an empty manifest. Other columns play no part.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"), "url", html.alias("html"))
    large = rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest")
    kept = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    told = large.join(kept.select("digest", "keeper"), "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("page_id", "digest", "keeper").distinct()
    # What a page revisits travels to the page's place in the sort and stands before it, so pages are shuffled once.
    both = told.select("page_id", "digest", F.lit(0).alias("kind"), "keeper", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).unionByName(
        rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("keeper"), "url", "html"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    ordered = both.repartitionByRange(max(1, -(-total // range_bytes), min(total >> 20, 64)), "page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        context = TaskContext.get()
        files: list[tuple] = []
        out, name, temp, n, size, sha = None, "", "", 0, 0, hashlib.sha256()
        pending = (None, None, None)

        def close():
            nonlocal out
            out.close()
            store.move(temp, f"{base}/{name}")
            files.append((name, n, size, sha.hexdigest()))
            out = None

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    pending = (r["page_id"], r["digest"], r["keeper"])
                    continue
                revisit = pending[:2] == (r["page_id"], r["digest"])
                data = _member(encode_record(r["page_id"], r["url"], r["html"].encode(), r["digest"], pending[2] if revisit else None, revisit))
                if out is not None and size + len(data) > file_bytes:
                    close()
                if out is None:
                    name = f"part-{context.partitionId():06d}-{len(files):05d}.warc.gz"
                    temp = f"{base}/_temporary/{name}.{context.taskAttemptId()}"
                    store.create_dir(f"{base}/_temporary", recursive=True)
                    out, n, size, sha = store.open_output_stream(temp), 0, 0, hashlib.sha256()
                out.write(data)
                sha.update(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], names=["file", "records", "bytes", "sha256"])

    ordered.mapInArrow(write, "file string, records long, bytes long, sha256 string").write.json(f"{folder}/manifest")


class _Hashed(io.RawIOBase):
    """A stream that counts and digests the bytes read from it."""

    def __init__(self, stream):
        self.stream, self.size, self.sha = stream, 0, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        self.size += len(data)
        self.sha.update(data)
        return len(data)


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, read as a stream."""
    with gzip.GzipFile(fileobj=stream) as f:
        lines = io.BufferedReader(f, 1 << 16)
        while first := lines.readline():
            if first.strip() != b"WARC/1.1":
                raise ValueError(f"not a record: {first[:40]!r}")
            headers = {}
            while line := lines.readline().rstrip(b"\r\n"):
                key, _, value = line.decode().partition(": ")
                headers[key] = value
            block = lines.read(int(headers["Content-Length"]))
            if len(block) != int(headers["Content-Length"]) or lines.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            yield headers, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives in the manifest: page_id, url as stored, payload (NULL for revisits), its bytes and hex
    SHA-1, record_type, and the page that a revisit refers to. There are as many tasks as files. Raises if a block or payload isn't
    what its digest says, or a file has other bytes or records than the manifest has it."""
    files = spark.read.schema("file string, records long, bytes long, sha256 string").json(f"{folder}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for listed in batch.to_pylist():
                rows, held, n = [], 0, 0
                with store.open_input_stream(f"{base}/{listed['file']}", compression=None) as stream:
                    hashed = _Hashed(stream)
                    for headers, block in _records(hashed):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = headers["WARC-Type"] == "revisit"
                        if headers["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}" or not revisit and (size, digest) != (len(payload), hashlib.sha1(payload).hexdigest()):
                            raise ValueError(f"a record of {listed['file']} isn't what its digest says")
                        page, to = headers.get("Page-ID"), headers.get("Refers-To-Page-ID")
                        rows.append((int(page) if page else None, headers["WARC-Target-URI"], None if revisit else payload.decode(), size, digest, headers["WARC-Type"], int(to) if to else None))
                        held, n = held + len(payload), n + 1
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if (n, hashed.size, hashed.sha.hexdigest()) != (listed["records"], listed["bytes"], listed["sha256"]):
                    raise ValueError(f"{listed['file']} isn't what the manifest says: {n} records, {hashed.size} bytes, {hashed.sha.hexdigest()}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # A number of partitions that is given stays, where adaptive execution would merge a shuffle of a few names into one task.
    return files.repartition(max(1, files.count()), "file").mapInArrow(read, RECORD)
