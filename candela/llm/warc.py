"""WARC archives of pages: writing them with an index, and reading selected records back by byte ranges.

Writing: each task writes one archive, a gzip member per record, and gives the index rows: file, offset, length, URL and
digest. Reading: the index comes first; the ranges of the selected records are sorted and neighbouring ones read at once.
Files go through pyarrow's file systems, so the folder can be on any store that those know (local or shared disk, object
stores, HDFS). The index names only the files of tasks that were committed; what a lost executor has left is not in it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import new_path, table, written

#: Payloads of fewer bytes are never deduplicated.
MIN_BYTES = 0
#: Neighbouring ranges are read at once if at most GAP bytes lie between them, up to SPAN bytes at a time.
GAP, SPAN = 64 << 10, 4 << 20
#: Bytes of archives that one reading task gets; less, down to SPAN, where there are cores for more tasks.
SPLIT = 64 << 20
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes | None, sha1: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit (refers_to) holds the HTTP header only; its digest and size are those of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + (payload or b"")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_uri(page_id)}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{_uri(refers_to)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The record's fields; raises ValueError if a response's payload does not have the digest in its header."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    sha1, page_id = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Record-ID"][12:-1]
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To", "<urn:x-page:>")[12:-1]
    return {
        "page_id": int(page_id) if page_id else None, "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": size,
        "payload_digest": sha1, "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        file = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, at = None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                    payload = (html or "").encode()
                    refers = first if first is not None and first != page_id else None
                    sha1, size = digest(payload), len(payload)
                    data = gzip.compress(record(page_id, url, payload, sha1, size, refers), 6, mtime=0)
                    out = out or store.open_output_stream(f"{path}/{file}", compression=None)
                    out.write(data)
                    rows.append((page_id, url, file, at, len(data), sha1, size, "response" if refers is None else "revisit", refers))
                    at += len(data)
                if rows:
                    yield _batch(rows, INDEX)
        finally:
            if out:
                out.close()

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    cols = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), cols, strict=True)], names=[n for n, _ in cols])


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives to folder and returns the index, as a written table.

    Of equal payloads of at least min_bytes bytes, the one with the smallest page_id is a response, the others are revisits
    of it. Null html is an empty payload, a null url an empty one. A null page_id comes after all others and is never
    referred to; rows that repeat a page_id are of one type. Without rows there are no archives and an empty index. Payloads
    of any length are written whole; further columns of pages are left out.
    """
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("html", F.coalesce("html", F.lit("")))
    key = F.sha2(F.col("html").cast("binary"), 256)
    firsts = rows.filter(F.octet_length("html") >= min_bytes).select(key.alias("key"), "page_id").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that a payload with very many pages is a partition of the join that can be split.
    repeated = written(firsts.filter("n > 1").select("key", "first"), "warc-firsts")
    typed = rows.withColumn("key", key).join(repeated, "key", "left").select("page_id", "url", F.when(F.col("first") == F.col("page_id"), None).otherwise(F.col("first")).alias("first"), "html")
    return written(typed.mapInArrow(_writer(folder), INDEX), "warc-index")


def ranges(places: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, indexes of the places in it) of coalesced reads; places: (offset, length), sorted by offset."""
    start = end = 0
    held: list[int] = []
    for i, (offset, length) in enumerate(places):
        if held and (offset > end + gap or max(end, offset + length) - start > span):
            yield start, end, held
            held = []
        if not held:
            start = end = offset
        held.append(i)
        end = max(end, offset + length)
    if held:
        yield start, end, held


def _reader(folder: str, gap: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, source = None, None
        try:
            for batch in batches:
                files, offsets, lengths = (batch[c].to_pylist() for c in ("file", "offset", "length"))
                at = 0
                while at < len(files):
                    stop = next((i for i in range(at, len(files)) if files[i] != files[at]), len(files))
                    if files[at] != name:
                        if source:
                            source.close()
                        name, source = files[at], store.open_input_file(f"{path}/{files[at]}")
                    places = list(zip(offsets[at:stop], lengths[at:stop], strict=True))
                    for start, end, held in ranges(places, gap, span):
                        data = source.read_at(end - start, start)
                        found = [parsed(gzip.decompress(data[places[i][0] - start : sum(places[i]) - start])) for i in held]
                        yield _batch([tuple(x.values()) for x in found], RECORDS)
                    at = stop
        finally:
            if source:
                source.close()

    return run


def reading_tasks(places: DataFrame, split: int = SPLIT) -> int:
    """How many tasks read these ranges: by the bytes behind the thin rows, which Spark does not see."""
    total = places.agg(F.sum("length")).first()[0] or 0
    cores = places.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // split), min(cores, -(-total // SPAN)))


def read_warc(index: DataFrame, folder: str, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """The records that index selects (any rows of it), one row each; a revisit's payload is empty.

    The ranges are sorted by file and offset over all tasks, so no archive is bound to one task, and a task gets about SPLIT
    bytes at most. An index row read twice
    gives its record twice; an empty index gives none; a damaged record raises an error.
    """
    places = index.select("file", "offset", "length")
    places = places.repartitionByRange(reading_tasks(places), "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(_reader(folder, gap, span), RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    index = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
