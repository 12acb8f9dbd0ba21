"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

A MinHash of fixed size cannot see a short item in a long document, so sketches grow where they must. Of an item's n
shingles a document may lack n - ceil(t n); the item's sketch is that many smallest hashes and one more, so a document that
contains the item has at least one of them. Documents are partitioned by size; each partition keeps the hashes up to the
largest sketch value of the items that fit into its documents, and nothing above it. The search has no false negatives; what
it finds is verified by the containment of the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import hash128, packed, small, table, unpacked, written

K, PERCENT = 5, 80


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), " ")


def _spots(w: Column, k: int) -> Column:
    n = F.size(w) - (k - 1)
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def shingle_texts(w: Column, k: int) -> Column:
    return F.array_distinct(F.transform(_spots(w, k), lambda i: F.array_join(F.slice(w, i, k), " ")))


def shingle_hashes(w: Column, k: int) -> Column:
    return F.transform(_spots(w, k), lambda i: F.xxhash64(*(F.get(w, i - 1 + j) for j in range(k))))


def sketches(items: DataFrame, k: int, percent: int, item_col: str, text_col: str) -> DataFrame:
    """item, item_id, n (its shingles), need (how many a document must have), size (words in a shingle), shingles, sketch.

    item is a hash of id and text, so that an item needs no id. The words of an item of fewer than k are its one shingle.
    """
    text = F.coalesce(items[text_col].cast("string"), F.lit(""))
    own = items.select(F.xxhash64(items[item_col].cast("long"), text).alias("item"), items[item_col].cast("long").alias("item_id"), words(F.coalesce(items[text_col].cast("string"), F.lit(""))).alias("w"))
    own = written(own, "bench-items")
    few = (F.size("w") < k) & (F.get("w", F.lit(0)) != "")
    shingles = F.when(few, F.array(F.array_join("w", " "))).otherwise(shingle_texts(F.col("w"), k))
    hashes = shingle_hashes(F.col("w"), k)
    for size in range(1, k):
        hashes = F.when(few & (F.size("w") == size), shingle_hashes(F.col("w"), size)).otherwise(hashes)
    own = own.select("item", "item_id", F.when(few, F.size("w")).otherwise(k).alias("size"), shingles.alias("shingles"), F.array_sort(F.array_distinct(hashes)).alias("hashes"))
    own = written(own, "bench-shingles").withColumn("n", F.size("shingles")).filter("n > 0").withColumn("need", F.ceil(F.col("n") * percent / 100 - 1e-9).cast("int"))
    return own.select("item", "item_id", "n", "need", "size", "shingles", F.slice("hashes", 1, F.col("n") - F.col("need") + 1).alias("sketch"))


def found_items(docs: DataFrame, items: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """k1, k2 (a hash of id and text), id, item_id, n, shared: the pairs with 100 * shared >= percent * n.

    n are the item's distinct k-word shingles, shared those that the document has too. An item with fewer than k
    words is one shingle, of all its words; an item without words is never found; null texts are empty. Each pair is there
    once, for repeated rows and repeated items too. Empty tables on either side give none. Very long texts are searched whole;
    further columns on either side are left out.
    """
    sketch = written(sketches(items, k, percent, item_col, item_text_col), "bench-sketches")
    # size classes by powers of two: at most 32 cutoffs, each of the items that the class's largest documents can contain
    class_of = lambda n: F.floor(F.log2(n)).cast("int")
    classes = sketch.filter(F.col("size") == k).select(F.explode(F.sequence(class_of(F.col("need")), F.lit(31))).alias("c"), F.array_max("sketch").alias("top")).groupBy("c").agg(F.max("top").alias("cutoff"))
    known = {x["c"]: x["cutoff"] for x in classes.collect()}
    cutoffs = F.array(*(F.lit(known.get(c)).cast("long") for c in range(32)))
    k1, k2 = hash128(F.col("id"), F.col("text"))
    rows = packed(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"k1": k1, "k2": k2})
    # w and m are columns of their own, so that no lambda computes them again; no filter stands on them, which would be pushed below
    sized = rows.select("k1", "k2", words(F.col("text")).alias("w")).withColumn("m", F.size("w") - (k - 1))
    hashed = sized.select("k1", "k2", "m", F.get(cutoffs, F.when(F.col("m") > 0, class_of(F.col("m"))).otherwise(F.lit(-1))).alias("cutoff"), shingle_hashes(F.col("w"), k).alias("hashes"))
    low = hashed.select("k1", "k2", "m", F.explode(F.filter("hashes", lambda h: h <= F.col("cutoff"))).alias("h"))
    pairs = low.join(sketch.filter(F.col("size") == k).select("item", "need", F.explode("sketch").alias("h")), "h").filter("m >= need").select("k1", "k2", "item")
    for x in sketch.filter(F.col("size") < k).groupBy("size").agg(F.max(F.array_max("sketch")).alias("cutoff")).collect():
        own = sized.select("k1", "k2", shingle_hashes(F.col("w"), x["size"]).alias("hashes"))
        own = own.select("k1", "k2", F.explode(F.array_distinct(F.filter("hashes", lambda h: h <= x["cutoff"]))).alias("h"))  # noqa: B023
        pairs = pairs.union(own.join(sketch.filter(F.col("size") == x["size"]).select("item", F.explode("sketch").alias("h")), "h").select("k1", "k2", "item"))
    pairs = pairs.distinct()
    pairs = written(pairs, "bench-pairs")
    both = rows.select("k1", "k2", "id", "text").join(small(pairs), ["k1", "k2"]).withColumn("w", words(F.col("text"))).withColumn("own", shingle_texts(F.col("w"), k))
    # a short item's words stand in a row in the document
    within = F.contains(F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")), F.concat(F.lit(" "), F.get("shingles", F.lit(0)), F.lit(" ")))
    shared = F.when(F.col("size") < k, within.cast("int")).otherwise(F.size(F.array_intersect("shingles", "own")))
    verified = both.select("k1", "k2", "id", "item", "w", "own").join(sketch.select("item", "item_id", "n", "size", "shingles"), "item").select("k1", "k2", "id", "item_id", "n", shared.alias("shared"))
    return written(verified, "bench-verified").filter(F.col("shared") * 100 >= F.col("n") * percent).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """docs without the rows that contain an item (see found_items()); all columns stay."""
    gone = written(found_items(docs, items, k, percent, id_col, text_col, **names).select("k1", "k2").distinct(), "bench-gone")
    k1, k2 = hash128(F.col("id"), F.coalesce("text", F.lit("")))
    return unpacked(packed(docs, id_col, text_col).withColumns({"k1": k1, "k2": k2}).join(small(gone), ["k1", "k2"], "left_anti"), docs, id_col, text_col)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = found_items(docs, items)
    return found.select(F.col("id").alias("doc_id"), "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("shared").cast("long").alias("n_shared"))


OP5_SQL = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM t),
s AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, n.id AS item_id, n.n AS n_shingles, count(*) AS n_shared
FROM s d JOIN s i ON d.s = i.s JOIN n ON n.id = i.id
WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL HAVING count(*) * 100 >= n.n * 80
"""
