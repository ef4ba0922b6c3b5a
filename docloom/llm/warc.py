"""WARC archives: write records, index them, and read selected records by byte range.

Records are written by Spark tasks to files in the cluster's shared storage. A
task names its files after itself and its attempt, and returns the index rows of
what it wrote; a file that no index row names (of a lost or repeated task)
belongs to nothing. Readers take index rows, sorted by file and offset, and join
neighbouring byte ranges into one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import materialize, shared_dir, ship

FILE_BYTES = 64_000_000  # an archive file is closed beyond this size
GAP_BYTES = 65_536  # ranges this close are read together
RANGE_BYTES = 8_000_000  # but no more than this at once
TASK_BYTES, MOST_TASKS = 4_000_000, 50_000  # archive bytes that a task reads back; beyond so many tasks each reads more

INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long, record_type string"


def digest32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, length: int, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has headers only."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else ""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:docloom:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {uri}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:docloom:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", compresslevel=3, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _page(urn: str | None) -> int | None:
    found = re.search(r"page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def classify(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url, html, digest, record_type, refers_to.

    Of payloads that are equal and have at least ``least_bytes`` bytes, that with
    the largest page_id is the response; the others revisit it. A null html is an
    empty payload; a null page_id is a response that nothing refers to; rows that
    share a page_id and payload have one type, and an empty table gives none. Other
    columns are ignored. Shuffled for
    this are digests, with one row a digest and task after a partial maximum;
    the join back is a sort-merge join whose hot digests Spark splits.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    counted = own.where((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull())
    shared = materialize(counted.groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first")).where("first < last").select("digest", "last"))
    joined = own.join(shared, "digest", "left")
    revisit = F.coalesce(F.col("page_id") < F.col("last"), F.lit(False))
    return joined.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records(page_id, url, html, record_type, refers_to)``; returns the index, as a table.

    Each row is one record, repeated ones too; a null url or page_id leaves its
    header out or empty; an empty table writes no file and has an empty index.

    ``folder`` is a URI of storage that all executors reach (file, hdfs, s3, gs).
    A payload is written while its record is at hand; a task holds one record.
    """
    ship(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        offset = 0
        for batch in batches:
            rows = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to")), strict=True):
                page_id, url, html, kind, refers_to = r
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = html.encode()
                digest = digest32(payload)
                member = record(page_id, url, payload, kind, digest, len(payload), refers_to)
                out.write(member)
                rows.append((name, offset, len(member), url, digest, page_id, kind))
                offset += len(member)
                if offset >= FILE_BYTES:
                    out.close()
                    out = None
            names = ["archive", "offset", "length", "url", "payload_digest", "page_id", "record_type"]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if out is not None:
            out.close()

    return materialize(records.mapInArrow(write, INDEX))


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of index rows ``selected(archive, offset, length, ...)``, read by byte range.

    Rows are ranged by archive and offset over the tasks, whose number follows
    the bytes to be read, not the size of the index; in a task, ranges at most GAP_BYTES apart are fetched in one read of up to RANGE_BYTES (or one
    larger record). Returns page_id, record_type, payload_digest, payload_bytes,
    refers_to, verified, and with ``payloads`` the payload (null for revisits).
    ``verified``: a response's payload has the digest and length of its headers.
    """
    ship(selected.sparkSession)
    names = ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "verified", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def fetch(rows: list[tuple[str, int, int]], store, root: str, opened: dict) -> list[bytes]:
        archive, start, stop = rows[0][0], rows[0][1], rows[-1][1] + rows[-1][2]
        if archive not in opened:
            for f in opened.values():
                f.close()
            opened.clear()
            opened[archive] = store.open_input_file(f"{root}/{archive}")
        data = opened[archive].read_at(stop - start, start)
        return [data[o - start : o - start + n] for _, o, n in rows]

    def parsed(members: list[bytes]) -> pa.RecordBatch:
        rows = []
        for m in members:
            h, body = parse(m)
            kind, digest, size = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
            ok = kind == "revisit" or (digest32(body) == digest and len(body) == size)
            rows.append((_page(h["WARC-Record-ID"]), kind, digest, size, _page(h.get("WARC-Refers-To")), ok, body if payloads and kind == "response" else None))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        run: list[tuple[str, int, int]] = []
        opened: dict = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if run:
                    end = run[-1][1] + run[-1][2]
                    if row[0] != run[-1][0] or row[1] - end > GAP_BYTES or row[1] + row[2] - run[0][1] > RANGE_BYTES:
                        yield parsed(fetch(run, store, root, opened))
                        run = []
                run.append(row)
        if run:
            yield parsed(fetch(run, store, root, opened))
        for f in opened.values():
            f.close()

    wanted = selected.select("archive", "offset", "length")
    tasks = min(MOST_TASKS, 1 + (wanted.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)
    ordered = wanted.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, verified boolean, payload binary")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: archive every page, index the archives, read every record back."""
    folder = shared_dir(spark)
    index = write_archives(classify(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    back = read_records(index, folder, payloads=False)
    checked = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record differs from its digest")).cast("string"))
    return back.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


#: The contract in DuckDB: the digest's base32 is read five bits at a time from its hexadecimal form.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT s, max(page_id) AS last FROM p GROUP BY s)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
    (strpos('0123456789abcdef', substring(p.s, CAST(i * 5 // 4 + 1 AS BIGINT), 1)) - 1) * 16 + strpos('0123456789abcdef', substring(p.s, CAST(i * 5 // 4 + 2 AS BIGINT), 1)) - 1) >> CAST(3 - i * 5 % 4 AS BIGINT)) % 32 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN m ON p.s = m.s
"""
