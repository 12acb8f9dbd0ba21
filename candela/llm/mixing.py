"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same expected number of copies. Their prefix sums, in the order of size within the
source, plus one random offset, give as many copies as integer boundaries are crossed. Taken in the order of size, the
copies are spread evenly over short and long documents, so the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.llm.common import packed, table, unpacked, written

WEIGHTS, SHARE_PERCENT, CAP, SEED = (5, 2, 1), 150, 2, 17
#: Expected copies are counted in this part of one, so that their sums are exact in any order.
UNIT = 1 << 24


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size), one row per source, with `target`.

    Sources by code point, null last, get the weights in turn and share percent % of all sizes; a target stops at cap times
    its source's size and the excess is shared again by weight. Sources fill up in the order of size / weight, so the ones
    that stop are a prefix of that order. The windows hold one row per source.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    nth = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("long")
    wide = F.col("source_size").cast("decimal(24,0)")  # products of sizes and weights pass 64 bits
    ranked = sizes.withColumn("source_size", wide).withColumn("weight", weight).withColumns({
        "total": F.sum("source_size").over(all_rows),
        "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap,
        "left": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # hundredths of words and whole weights, compared without division
    stops = (percent * F.col("total") - 100 * F.col("full")) * F.col("weight") >= 100 * cap * F.col("source_size") * F.col("left")
    ranked = ranked.withColumn("stops", stops)
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "full", "left"))).over(all_rows)
    share = (F.col("weight") * (percent * F.col("total") - 100 * F.col("first.full"))).cast("double") / (100 * F.col("first.left")).cast("double")
    return ranked.withColumn("first", first).select("source", F.col("source_size").cast("long").alias("source_size"), F.when(F.col("stops"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, with_text: bool = True, **how) -> DataFrame:
    """Rows of docs in the form of packed(), with size (words), source, source_size, target and copies.

    Null texts have size 0. A null source is a source of its own, the last. Reruns agree: the order is by source, size and
    id, the offset a hash of seed and source; sums are exact. Rows with equal id and size may swap their copies. If all
    sizes of a source are 0 its target is 0 and it gives no copies. An empty table gives an empty one. with_text=False
    leaves the texts out once their words are counted. Very long texts are counted whole; further columns are in `rest`.
    """
    rows = packed(docs, id_col, text_col).withColumn("source", F.col("rest").getField(source_col).cast("string")).withColumn("size", words(F.col("text")))
    if not with_text:
        rows = rows.withColumn("text", F.lit(None).cast("string"))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("id")]
    # monotonically_increasing_id: the partition's number in the high 31 bits, the row's place in the low 33
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "mix")
    parts = placed.groupBy("source", F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("start"), F.sum("size").alias("words"))
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    # one row per source and partition; a source's rows are contiguous in each
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("start")
    starts = parts.withColumn("shift", before).select(F.col("source").alias("s1"), "part", "shift")
    goals = targets(sizes, **how).withColumnRenamed("source", "s2")
    units = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    offset = F.shiftright(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 8), 16, 10).cast("long"), 8)
    plan = starts.join(goals, F.col("s1").eqNullSafe(F.col("s2"))).select(F.col("s1").alias("s"), "part", "shift", "source_size", "target", units.alias("units"))
    out = placed.withColumn("p", F.shiftright("place", 33)).join(plan, (F.col("p") == F.col("part")) & F.col("source").eqNullSafe(F.col("s")))
    up_to = (F.col("place") + F.col("shift") + 1) * F.col("units") + offset
    copies = F.shiftright(up_to, 24) - F.shiftright(up_to - F.col("units"), 24)
    return out.withColumn("copies", copies).select("id", "text", "rest", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken (see mixed()), with all its columns."""
    found = mixed(docs, id_col, text_col, source_col, seed, **how).filter("copies > 0")
    return unpacked(found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs, id_col, text_col)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), with_text=False)
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, sum(source_size) OVER () AS total,
    2 * coalesce(sum(source_size) OVER w, 0) AS filled,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (150 * total - 100 * filled) * weight >= 200 * source_size * rest AS stops FROM f),
h AS (SELECT *, min(CASE WHEN NOT stops THEN {{'r': source_size / weight, 'f': filled, 'w': rest}} END) OVER () AS first FROM g),
t AS (
  SELECT source, source_size, CASE WHEN stops THEN (2 * source_size)::DOUBLE
    ELSE (weight * (150 * total - 100 * first.f))::DOUBLE / (100 * first.w)::DOUBLE END AS target FROM h),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * {UNIT})::BIGINT ELSE 0 END AS units,
    ('0x' || substr(md5('{SEED}:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8))::BIGINT // 256 AS shift
  FROM t),
r AS (
  SELECT doc_id, size, source_size, target, units,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) * units + shift AS up_to
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (up_to // {UNIT} - (up_to - units) // {UNIT}) * size AS taken FROM r
"""
