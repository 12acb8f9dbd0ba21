"""The prefix trie of a corpus of conversations, by prefix-doubling naming.

Every turn gets a dense name, equal for equal turns. Two neighbouring blocks of 2^j named turns make a block of 2^(j+1), whose name is
that of the pair of names; so after log2(longest) rounds of joins all aligned blocks of all sizes are named, and a round has half
as many rows as the one before. A prefix of d turns is composed of the blocks of d's binary digits, largest first: a
prefix that ends with a block of 2^j is named by the pair of the prefix before that block and the block. From the largest size
downwards, each round names the prefixes whose lowest digit is 2^j. Equal names are equal prefixes, which are the nodes of the trie.

Sums over subtrees need no walk either. A node's representative is its smallest member; the nodes that a conversation represents are
the end of its path, so the sum over a node's subtree is, over its members, the sum of what each represents from that depth on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.llm.common import column, table, written
from candela.operators.scans import running

#: Turns of a conversation that one task scans at once.
SLICE = 1 << 12
#: Ids that are joined to one piece of text before hashing.
IDS = 1 << 12
ROOT = 0
IN_PARTITION = (1 << 33) - 1


def _positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `pos`, each one's place within its key. A key may fill many partitions: the rows that it has in those before are carried on."""
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(parts, [*keys, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def placed(df: DataFrame, keys: list[str], order: list[Column], keep: list[str], label: str) -> DataFrame:
    """keys and `keep` of df with `pos`, each row's place within its key in that order, from 0; it is sorted over range partitions and written."""
    by = [*(F.col(k) for k in keys), *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, *keep, F.monotonically_increasing_id().alias("_at"))
    return _positions(written(rows, label), keys)


def named(rows: DataFrame, columns: list[str], name: str, label: str, first: int = 0, keep: tuple[Column, ...] = ()) -> tuple[DataFrame, int]:
    """rows with a dense name of their columns in place of them, from `first` on, and the number after the last name.

    Each distinct row of columns is numbered once, within its partition; partitions follow each other. Rows are joined to that
    dictionary, which holds each key once. keep: columns over the dictionary that come along.
    """
    spark = rows.sparkSession
    known = written(rows.select(*columns).distinct().withColumn("_at", F.monotonically_increasing_id()), f"{label}-names")
    part = F.shiftright("_at", 33)
    counts = sorted((x[0], x[1]) for x in known.groupBy(part.alias("_part")).count().collect())  # one for each partition
    bases = []
    for p, n in counts:
        bases.append((p, first))
        first += n
    base = F.broadcast(spark.createDataFrame(bases, "_part long, _base long"))
    dictionary = known.withColumn("_part", part).join(base, "_part").select(*columns, (F.col("_base") + F.col("_at").bitwiseAND(F.lit(IN_PARTITION))).alias(name), *keep)
    return rows.join(dictionary, columns).drop(*columns), first


class Trie:
    """The nodes of `turns` (conv, pos, key, n_bytes: a row a turn, pos from 0 without gaps) over all conversations `convs` (conv)."""

    def __init__(self, convs: DataFrame, turns: DataFrame) -> None:
        self.convs, self.turns = convs, turns

    def prefixes(self) -> DataFrame:
        """conv, depth, node of each prefix of each conversation, the root included."""
        rows, _ = named(self.turns.select("conv", F.col("pos").alias("i"), "key"), ["key"], "name", "trie-turns")
        blocks = [written(rows, "trie-blocks-0")]
        size = self.turns.agg(F.max("pos")).first()[0]
        top = 0 if size is None else (size + 1).bit_length() - 1
        for j in range(1, top + 1):
            odd = F.col("i").bitwiseAND(F.lit(1)) == 1
            two = blocks[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(F.max(F.when(~odd, F.col("name"))).alias("x"), F.max(F.when(odd, F.col("name"))).alias("y")).filter("y IS NOT NULL")
            rows, _ = named(two, ["x", "y"], "name", f"trie-pairs-{j}")
            blocks.append(written(rows, f"trie-blocks-{j}"))
        found, after = self.convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).cast("long").alias("node")), ROOT + 1
        for j in range(top, -1, -1):
            # the blocks at even places are the last of their prefixes: the digits above end where they begin
            last = blocks[j].filter(F.col("i").bitwiseAND(F.lit(1)) == 0).select("conv", F.shiftleft("i", j).alias("depth"), "name")
            both = last.join(found.withColumnRenamed("node", "before"), ["conv", "depth"])
            rows, after = named(both, ["before", "name"], "node", f"trie-prefixes-{j}", after)
            found = found.union(written(rows.select("conv", (F.col("depth") + (1 << j)).alias("depth"), "node"), f"trie-nodes-{j}"))
        return found

    def nodes(self) -> DataFrame:
        """One row per node: node, depth, rep (the smallest member), parent, n_convs, n_children, n_leaves, saved and last_bytes (UTF-8 bytes of its last text)."""
        paths = written(self.prefixes(), "trie-paths")
        groups = written(paths.groupBy("node", "depth").agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs")), "trie-groups")
        here = self.turns.select(F.col("conv").alias("rep"), (F.col("pos") + 1).alias("depth"), "n_bytes")
        above = paths.select(F.col("conv").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
        nodes = groups.join(above, ["rep", "depth"], "left").join(here, ["rep", "depth"], "left")
        nodes = written(nodes.withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0))), "trie-groups-parents")
        children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
        nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
        weights = nodes.select(F.col("rep").alias("conv"), "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
        weighed = written(paths.join(weights, ["conv", "depth"], "left"), "trie-weights")
        part = F.floor(F.col("depth") / SLICE)
        below = running(weighed, ["conv"], "depth", part, {c: ("sum", F.coalesce(c, F.lit(0))) for c in ("leaf", "saved")}, descending=True)
        sums = below.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved"))
        self.paths = paths
        return written(nodes.withColumnRenamed("n_bytes", "last_bytes").join(sums, "node"), "trie")

    def ends(self) -> DataFrame:
        """node, sha256: of the decimal numbers of the conversations that end at a node, in order, joined by commas; nodes at which none ends are left out.

        Ids are joined to pieces of IDS at most, wherever they lie; a hash then reads a node's pieces one after the other, which holds
        one piece at a time and is as much as SHA-256 can be divided.
        """
        length = self.turns.groupBy("conv").agg((F.max("pos") + 1).alias("depth"))
        last = self.convs.select("conv").join(length, "conv", "left").select("conv", F.coalesce("depth", F.lit(0)).alias("depth"))
        at = placed(last.join(self.paths, ["conv", "depth"]).select("node", "conv"), ["node"], [F.col("conv")], ["conv"], "trie-ends")
        pieces = at.groupBy("node", F.floor(F.col("pos") / IDS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
        return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(_hash, "node long, sha256 string")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None
    for batch in batches:
        out = []
        for node, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if node == now:
                state.update(b",")
            else:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["node", "sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["node", "sha256"])


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos, key and n_bytes: the turns of each conversation in the order of turn (null first), then role and text.

    key is a SHA-256 of role and text, null ones empty; n_bytes are the UTF-8 bytes of the text. Rows without a conversation belong to
    none and are left out; repeated rows are turns of their own. Very long texts are read whole; further columns are left out.
    """
    c = {x: column(conversations, x) for x in (conv_col, turn_col, role_col, text_col)}
    rows = conversations.select(
        c[conv_col].cast("long").alias("conv"), c[turn_col].cast("long").alias("turn"),
        *(F.coalesce(c[x].cast("string"), F.lit("")).alias(n) for x, n in ((role_col, "role"), (text_col, "text"))),
    ).filter("conv IS NOT NULL")
    # the length of the role keeps it apart from the text
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumns({"key": key, "n_bytes": F.octet_length("text").cast("long")})
    return placed(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["key", "n_bytes"], "trie-sorted")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per distinct prefix of conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv, pos (from 0, without gaps), key, n_bytes, as ordered_turns() gives them. convs: all conversations (conv), those
    without turns too. Counts are of members; n_leaves and saved_tokens are sums over the subtree, of childless nodes and of (members - 1)
    times the bytes of the last text. No conversations give no nodes; conversations without turns give the root.
    """
    turns = written(turns, "trie-turns")
    convs = written((turns.select("conv") if convs is None else convs.select("conv")).distinct(), "trie-convs")
    trie = Trie(convs, turns)
    nodes = trie.nodes()
    parents = nodes.select(F.col("node").alias("parent"), F.col("rep").alias("parent_conv_id"))
    found = nodes.join(parents, "parent", "left").join(trie.ends(), "node", "left")
    return found.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations as op11 rebuilds them: c begins with the first h turns of conversation c - c % 5, then follow c's own after its first h; h = crc32(c) % 9."""
    turns = written(turns, "trie-original")
    c = F.col("conv")
    lengths = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = lengths.select(c, (c - c % 5).alias("donor"), (F.crc32(c.cast("string").cast("binary")) % 9).alias("h"))
    convs = written(convs.join(lengths.select(F.col("conv").alias("donor"), F.col("n").alias("given")), "donor", "left").withColumn("given", F.least("h", F.coalesce("given", F.lit(0)))), "trie-rebuilt")
    first = turns.filter("pos < 8").withColumnRenamed("conv", "donor").join(convs.select("conv", "donor", "h"), "donor").filter("pos < h")
    own = turns.join(convs.select("conv", "h", "given"), "conv").filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("given"))
    columns = ("conv", "pos", "key", "n_bytes")
    return first.select(*columns).union(own.select(*columns)), convs.select("conv")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(ordered_turns(table(spark, sf_dir, "conversations"))))


#: CRC-32 of the id's digits, a bit at a time; prefixes as lists of hashes of their turns.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, c - c % 5 AS g, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, x: list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384::BIGINT)))) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT h.c, 0 AS own, t.p, k, b FROM h JOIN t ON t.c = h.g AND t.p < h.h UNION ALL
  SELECT h.c, 1, t.p, k, b FROM h JOIN t ON t.c = h.c AND t.p >= h.h),
s AS (
  SELECT c, row_number() OVER w AS d, b, sha256(array_to_string(list(k) OVER (PARTITION BY c ORDER BY own, p ROWS UNBOUNDED PRECEDING), ',')) AS n FROM r
  WINDOW w AS (PARTITION BY c ORDER BY own, p)
  UNION ALL SELECT c, 0, 0, 'root' FROM h),
l AS (SELECT c, max(d) AS len FROM s GROUP BY c),
n AS (
  SELECT n, d, min(c) AS rep, count(*) AS members, any_value(b) AS b, string_agg(CASE WHEN len = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM s JOIN l USING (c) GROUP BY n, d),
u AS (SELECT n.*, p.n AS parent FROM n LEFT JOIN s p ON p.c = n.rep AND p.d = n.d - 1),
k AS (SELECT parent, count(*) AS kids FROM u WHERE parent IS NOT NULL GROUP BY parent),
x AS (SELECT u.*, coalesce(kids, 0) AS kids FROM u LEFT JOIN k ON k.parent = u.n),
a AS (SELECT s.n, sum((x.kids = 0)::BIGINT) AS leaves, sum((x.members - 1) * x.b) AS saved FROM x JOIN s ON s.c = x.rep AND s.d <= x.d GROUP BY s.n)
SELECT x.rep AS conv_id, x.d::BIGINT AS depth, q.rep AS parent_conv_id, x.members AS n_convs, x.kids AS n_children, a.leaves::BIGINT AS n_leaves,
  a.saved::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM x JOIN a USING (n) LEFT JOIN n q ON q.n = x.parent
"""
