"""Token counts behind a digest cache.

A count depends on the content and on the tokenizer, so it is stored under the digests of both. A call joins the digests
of its texts to the stored counts, encodes each distinct text that is missing once, and appends those counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import discard, hash128, new_path, packed, table, written

LIMIT = 2048
COUNTS = "text_digest binary, n_tokens long"
STORED = COUNTS + ", tokenizer_digest string, level int, shard string"
#: Hex digits of a shard at first; with more than about SHARD_ROWS rows in a shard, new counts go to shards of a digit more.
LEVEL, SHARD_ROWS = 2, 100_000
#: Shards of a level that a call names; a call that needs more reads the level.
NAMED = 4096
#: Words whose counts a task remembers, and the longest such word.
WORDS, WORD_CHARS = 200_000, 64


def tokenizer_digest(vocabulary: bytes) -> str:
    """Of the file and of the library's version, which together make the counts."""
    import tokenizers

    return hashlib.sha256(b"tokenizers " + tokenizers.__version__.encode() + b"\n" + vocabulary).hexdigest()


def splits_at_spaces(vocabulary: str) -> bool:
    """Whether the tokenizer drops white space between words, so that a text's count is the sum over its words."""
    import json

    pre = json.loads(vocabulary).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "\\s" in str(first.get("pattern")) and " ?" not in str(first.get("pattern"))


def counter(vocabulary: str):
    """texts -> their counts. Where white space is dropped, words are encoded once and remembered; rare long ones are not."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encoded(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not splits_at_spaces(vocabulary):
        return encoded
    known: dict[str, int] = {"": 0}

    def learn(words: list[str]) -> None:
        """All new words as one text, which costs far less than each as its own; offsets tell whose tokens are whose."""
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        at = [x for x, _ in tokenizer.encode(" ".join(words), add_special_tokens=False).offsets]
        known.update(zip(words, np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(words)).tolist(), strict=False))

    def by_word(texts: list[str]) -> list[int]:
        # ASCII spaces only: no rule of the tokenizer reaches across them
        parts = [text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") for text in texts]
        new = [w for w in set().union(*parts) if w not in known]
        if len(known) + len(new) > WORDS:
            known.clear()
            known[""] = 0
            new = list(set().union(*parts) - {""})
        if new:
            learn(new)
        out = [sum(map(known.__getitem__, ws)) for ws in parts]
        for w in new:
            if len(w) > WORD_CHARS:
                del known[w]
        return out

    return by_word


def _encode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            n: list[int] = []
            for i in range(0, len(texts), 128):
                n += count(texts[i : i + 128])
            yield pa.RecordBatch.from_arrays([batch["text_digest"], pa.array(n, pa.int64())], names=["text_digest", "n_tokens"])

    return run


def _shard(level: int):
    return F.lower(F.substring(F.hex("text_digest"), 1, level)).alias("shard")


def _names(spark: SparkSession, folder: str) -> list[str]:
    """The values in the names of a folder's subfolders `column=value`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(x.partition("=")[2] for x in found if "=" in x)


def _levels(spark: SparkSession, cache: str, version: str) -> list[int]:
    return sorted(map(int, _names(spark, f"{cache}/tokenizer_digest={version}")))


def _level(spark: SparkSession, cache: str, version: str, more: int) -> int:
    """The level to which `more` rows go. Digests are even, so one shard tells how full a level is; a level's shards hold 16 times SHARD_ROWS at most."""
    top = max(_levels(spark, cache, version), default=LEVEL)
    shards = _names(spark, f"{cache}/tokenizer_digest={version}/level={top}")
    held = spark.read.schema(COUNTS).parquet(f"{cache}/tokenizer_digest={version}/level={top}/shard={shards[0]}").count() * len(shards) if shards else 0
    while (held + more) >> (4 * top) > SHARD_ROWS:
        top, held = top + 1, 0
    return top


def _stored(spark: SparkSession, cache: str, version: str, digests: DataFrame) -> DataFrame:
    """The cache's counts of the digests. Its folders are tokenizer, level and shard, so a call reads only the shards that it needs."""
    spark.createDataFrame([], STORED).write.mode("append").partitionBy("tokenizer_digest", "level", "shard").parquet(cache)
    needed = F.lit(False)
    for level in _levels(spark, cache, version):
        shards = [x["shard"] for x in digests.select(_shard(level)).distinct().limit(NAMED + 1).collect()]
        needed = needed | ((F.col("level") == level) & (F.col("shard").isin(shards) if len(shards) <= NAMED else F.lit(True)))
    of = spark.read.schema(STORED).parquet(cache).filter((F.col("tokenizer_digest") == version) & needed)
    return of.select("text_digest", "n_tokens").join(digests, "text_digest", "left_semi").groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _append(new: DataFrame, cache: str, version: str) -> None:
    """Stores counts, a file a shard, sorted by digest."""
    level = _level(new.sparkSession, cache, version, new.count())
    rows = new.select("text_digest", "n_tokens", F.lit(version).alias("tokenizer_digest"), F.lit(level).alias("level"), _shard(level))
    rows.repartition("shard").sortWithinPartitions("shard", "text_digest").write.mode("append").partitionBy("tokenizer_digest", "level", "shard").parquet(cache)


def compact(spark: SparkSession, cache: str, most: int = 16) -> int:
    """Merges the files of shards that have more than `most` of them, and drops what they hold twice; the number of such shards.

    Calls append a file to each shard that they add to, so a cache that many small calls share wants this now and then. Other shards
    are not read or written. No call may append meanwhile; a run that fails on the way can be repeated.
    """
    keys = ("tokenizer_digest", "level", "shard")
    files = spark.read.schema(STORED).parquet(cache).select(*keys, F.input_file_name().alias("file")).groupBy(*keys).agg(F.count_distinct("file").alias("files"))
    many = files.filter(F.col("files") > most).collect()  # names of folders
    if many:
        these = F.lit(False)
        for version, level in sorted({x[:2] for x in many}):
            these = these | ((F.col("tokenizer_digest") == version) & (F.col("level") == level) & F.col("shard").isin([x["shard"] for x in many if x[:2] == (version, level)]))
        merged = written(spark.read.schema(STORED).parquet(cache).filter(these).groupBy(*keys, "text_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-merged")
        put = merged.repartition(*keys).sortWithinPartitions(*keys, "text_digest")
        put.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(cache)
        discard(merged)
    return len(many)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit per row of docs, each row once; null is an empty text with no tokens. An empty table gives an empty one.

    tokenizer: the path of a tokenizers .json file on the driver. cache: a folder of Parquet that all calls may share; calls
    that append at the same time at worst store a count twice. Counts are without added tokens, truncation or padding. Whole
    texts are counted, very long ones too; further columns of docs are left out.
    """
    spark = docs.sparkSession
    vocabulary = Path(tokenizer).read_bytes()
    version = tokenizer_digest(vocabulary)
    k1, k2 = hash128(F.col("id"), F.col("text"))
    rows = packed(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"k1": k1, "k2": k2})
    thin = rows.select("k1", "k2", "id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    thin = written(thin, "token-texts")
    distinct = thin.groupBy("text_digest").agg(F.min(F.struct("k1", "k2")).alias("one"))
    hits = written(_stored(spark, cache, version, thin.select("text_digest")), "token-hits")
    # of each distinct text that is missing, one row is encoded
    chosen = written(distinct.join(hits, "text_digest", "left_anti").select("one.*", "text_digest"), "token-misses")
    misses = rows.select("k1", "k2", "text").join(chosen, ["k1", "k2"])
    counted = misses.select("text_digest", "text").mapInArrow(_encode(vocabulary.decode()), COUNTS)
    new = written(counted.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-new")
    _append(new, cache, version)
    return thin.join(hits.unionByName(new), "text_digest").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is new for each call of this query, so that a measured run encodes all distinct texts."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-cache"))
    return found.withColumnRenamed("id", "doc_id")
