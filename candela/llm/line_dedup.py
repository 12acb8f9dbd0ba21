"""Line deduplication with DataFrame functions only.

Lines are exploded and hashed; hashes that enough distinct documents hold make a table of repeated lines; what each
document loses is a list of positions, by which its text is reassembled. Line texts themselves are never shuffled,
documents once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import LOWEST, SPACES, ascii_lower, hash128, packed, table, unpacked, written

MIN_CHARS, MIN_DOCS = 10, 2


def line_drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs in the form of packed(), with `lines` and `dropped`, the positions that go (null: none).

    A line's key is the line without spaces at its ends, A-Z lower-cased. Keys of at least min_chars characters found in
    at least min_docs documents lose all their lines, but for the document with the smallest id. Null or empty text is one
    empty line. A null id is one document, below all others; rows with the same id are one document; repeated rows
    lose the same lines. An empty table gives an empty one. Very long texts are split whole; further columns are in `rest`.
    """
    k1, k2 = hash128(F.col("id"), F.col("text"))
    rows = packed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"k1": k1, "k2": k2})
    key = F.btrim(F.col("line"), F.lit(SPACES))
    h1, h2 = hash128(F.col("key"))
    lines = (
        rows.select("k1", "k2", F.coalesce("id", F.lit(LOWEST)).alias("id"), F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line"))
        .withColumn("key", key).filter(F.char_length("key") >= min_chars)
        .select("k1", "k2", "id", "pos", h1.alias("h1"), h2.alias("h2"))
    )
    by_key = lines.groupBy("h1", "h2")
    # Two documents or more: the smallest id is not the largest, which partial aggregation settles before the shuffle.
    found = by_key.agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last") if min_docs == 2 else by_key.agg(F.min("id").alias("first"), F.count_distinct("id").alias("n")).filter(F.col("n") >= min_docs)
    # Written, so that both sides of the join are plain exchanges, of which a hot line's partition can be split.
    repeated = written(found.select("h1", "h2", "first"), "lines")
    drops = lines.join(repeated, ["h1", "h2"]).filter("id <> first").groupBy("k1", "k2").agg(F.collect_set("pos").alias("dropped"))
    return rows.join(drops, ["k1", "k2"], "left").withColumn("lines", F.split("text", "\n"))


def _kept_text():
    """The lines that stay, joined; array_except keeps their order and works by hashing."""
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    return F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with the repeated lines gone from the texts (see line_drops()); null texts become empty."""
    found = line_drops(docs, min_chars, min_docs, id_col, text_col)
    return unpacked(found.withColumn("text", _kept_text()), docs, id_col, text_col)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_drops(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        F.sha2(_kept_text().cast("binary"), 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, r.first IS NOT NULL AND r.first <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
