"""Exact deduplication by Grace hashing.

Each task partitions its records to spill files, again and again, until a bucket fits an open-addressing table that
compares complete contents. It runs twice: over each input partition, where copies collapse before anything is
shuffled, and then over the buckets of the shuffled survivors. A text that makes up a third of all rows is thus one
record per input partition in the shuffle.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import packed, table, unpacked, written

#: Bytes of content that one open-addressing table may hold before its bucket is spilled.
TABLE_BYTES = 64 << 20
FANOUT = 16
#: Numbers of one text's rows that are held in memory.
CHUNK = 1 << 16


class Members:
    """The rows of one text, four numbers each: whether there is an id, the id, -row, and how many rows it stands for.

    The best of them and the sum of rows are kept as they come; from CHUNK numbers on, rows go to a file.
    """

    def __init__(self) -> None:
        self.tail, self.file, self.best, self.rows = array("q"), None, None, 0

    def add(self, chunk: array, top: tuple, rows: int) -> None:
        self.best = top if self.best is None else max(self.best, top)
        self.rows += rows
        self.tail.extend(chunk)
        if len(self.tail) >= CHUNK:
            self.file = self.file or tempfile.TemporaryFile()
            self.tail.tofile(self.file)
            self.tail = array("q")

    def chunks(self) -> Iterator[array]:
        if self.file:
            self.file.seek(0)
            while data := self.file.read(8 * CHUNK):
                yield array("q", data)
        if self.tail:
            yield self.tail

    def __iter__(self) -> Iterator[tuple]:
        """id, row of each."""
        for c in self.chunks():
            for has, i, minus in zip(c[::4], c[1::4], c[2::4], strict=True):
                yield i if has else None, -minus


def record(content: bytes, i: int | None, row: int, rows: int, payload: bytes) -> list:
    """Of rows with equal texts the largest id stays, then the first row; no id is less than any."""
    top = (i is not None, i or 0, -row)
    return [hashlib.sha256(content).digest(), content, array("q", [*top, rows]), top, rows, payload]


class Table:
    """Open addressing with linear probing; equal digests still compare their contents. Entries: digest, content, members, payload of the best."""

    def __init__(self) -> None:
        self.slots, self.entries, self.bytes = [-1] * 1024, [], 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        i = int.from_bytes(digest[-8:], "big") & mask
        while (e := self.slots[i]) >= 0 and not (self.entries[e][0] == digest and self.entries[e][1] == content):
            i = (i + 1) & mask
        return i

    def add(self, new: list) -> None:
        digest, content, chunk, top, rows, payload = new
        i = self._slot(digest, content)
        if (e := self.slots[i]) >= 0:
            old = self.entries[e]
            if top > old[2].best:
                self.bytes += len(payload) - len(old[3])
                old[3] = payload
            before = len(old[2].tail)
            old[2].add(chunk, top, rows)
            self.bytes += 8 * (len(old[2].tail) - before)
            return
        self.slots[i] = len(self.entries)
        members = Members()
        members.add(chunk, top, rows)
        self.entries.append([digest, content, members, payload])
        self.bytes += len(content) + len(payload) + 400
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for n, old in enumerate(self.entries):
                self.slots[self._slot(old[0], old[1])] = n

    def records(self) -> Iterator[list]:
        """The entries as records again; members in a file give a record a chunk."""
        for digest, content, members, payload in self.entries:
            for c in members.chunks():
                yield [digest, content, c, max(zip(c[::4], c[1::4], c[2::4], strict=True)), sum(c[3::4]), payload]


def grace(records: Iterator[list], budget: int, folder: Path, depth: int = 0) -> Iterator[list]:
    """Groups of records with equal contents: [digest, content, members, payload of the best member]."""
    held, files = Table(), []
    try:
        for x in records:
            if not files:
                held.add(x)
                if held.bytes <= budget or len(held.entries) < 2 or depth >= 32:
                    continue
                folder.mkdir(parents=True, exist_ok=True)
                files = [(folder / f"{depth}-{n}").open("w+b") for n in range(FANOUT)]
                for y in held.records():
                    pickle.dump(y, files[_digit(y[0], depth)], protocol=5)
                held = Table()
            else:
                pickle.dump(x, files[_digit(x[0], depth)], protocol=5)
        yield from held.entries
        for n, f in enumerate(files):
            f.seek(0)
            yield from grace(_spilled(f), budget, folder / str(n), depth + 1)
            f.close()
    finally:
        for f in files:
            f.close()
        shutil.rmtree(folder, ignore_errors=True)


def _digit(digest: bytes, depth: int) -> int:
    return digest[depth // 2] >> (4 * (depth % 2)) & 15


def _spilled(f) -> Iterator[list]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + (len(row[2]) if len(row) > 2 and isinstance(row[2], str) else 0)
        if size > 8 << 20 or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _locally(budget: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33

        def records() -> Iterator[list]:
            row = base
            for batch in batches:
                for i, text, rest in zip(*(batch[c].to_pylist() for c in ("id", "text", "rest")), strict=True):
                    yield record((text or "").encode().lower(), i, row, 1, pickle.dumps((text, rest)))
                    row += 1

        def rows() -> Iterator[tuple]:
            with tempfile.TemporaryDirectory() as tmp:
                for digest, _, members, payload in grace(records(), budget, Path(tmp, "grace")):
                    stays, sha = -members.best[2], digest.hex()
                    text, rest = pickle.loads(payload)
                    for i, row in members:
                        first = row == stays
                        yield i, row, text if first else None, rest if first else None, stays, sha, members.rows if first else None

        yield from _batches(rows(), schema)

    return run


def _globally(budget: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[list]:
            for batch in batches:
                for i, row, text, n in zip(*(batch[c].to_pylist() for c in ("id", "row", "text", "n")), strict=True):
                    yield record((text or "").encode().lower(), i, row, n, b"")

        def rows() -> Iterator[tuple]:
            with tempfile.TemporaryDirectory() as tmp:
                for _, _, members, _ in grace(records(), budget, Path(tmp, "grace")):
                    has, i, minus = members.best
                    for _, row in members:
                        yield row, -minus, i if has else None, members.rows

        yield from _batches(rows(), schema)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256; rows that stay also hold text and rest.

    Texts are equal when identical after lower-casing A-Z; null is empty. The largest id stays, of rows with the same id
    any one; a null id is below all others. No row of docs is lost, repeated rows included; empty tables give none.
    Very long texts are compared whole; further columns are in `rest`.
    """
    rows = packed(docs, id_col, text_col)
    f = rows.schema
    local = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", T.LongType()), f["text"], T.StructField("rest", f["rest"].dataType), T.StructField("rep", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("n", T.LongType())])
    found = T.StructType([T.StructField(c, T.LongType()) for c in ("rep", "keep_row", "keep_id", "group_size")])
    held = written(rows.mapInArrow(_locally(table_bytes, _arrow(local)), local), "exact")
    merged = (
        held.filter("row = rep").select("id", "row", "text", "n", "text_sha256").repartition("text_sha256").select("id", "row", "text", "n")
        .mapInArrow(_globally(table_bytes, _arrow(found)), found)
    )
    return held.select("id", "row", "text", "rest", "rep", "text_sha256").join(merged, "rep").withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, the one with the largest id (see groups())."""
    return unpacked(groups(docs, id_col, text_col, table_bytes).filter("kept"), docs, id_col, text_col)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
