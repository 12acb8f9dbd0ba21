"""Near-duplicates by SimHash: pairs of fingerprints within three bits, found by vantage-point trees.

A vantage-point tree parts fingerprints by their distance from a vantage point: up to a radius to the left, beyond it to the
right. Two fingerprints that a distance of `reach` joins differ by at most that in their distances from the vantage point
(triangle inequality), so those on the right within `reach` of the border also go to the left, and every pair meets in a
leaf. Whole distances of 64 bits concentrate around 32, and a border of three bits would hold a quarter of all fingerprints at each
node. So there are two trees, one for the distance over each half of the bits, which bounds the whole distance from below: of
three differing bits one half has at most one, so each pair has a tree whose borders are one bit wide. Where a half no longer
parts a node, the whole distance does, with a border of three.

The upper levels are fitted on a bounded sample and deal all fingerprints to shards. A task grows the tree further over the rows of
its shard, compares whole distances in the leaves, and returns a spanning forest of what it links, so a group of n near copies
gives n - 1 edges and not all its pairs. Shards that are still too large are dealt again by a tree of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import packed, small, table, written
from candela.llm.ngram_join import connected

SEED = 42
#: Fingerprints on which a round's upper levels are fitted, at most (about, in later rounds).
SAMPLE = 1 << 16
#: Fingerprints a shard is meant to hold, and with how many it is dealt again.
SHARD, LIMIT = 1 << 13, 1 << 20
#: Fingerprints of a leaf that are compared with each other.
LEAF = 256
WHOLE = 2**64 - 1


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of fewer words, one of them all; without words, none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z, and \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(x, k)) for x in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def halves(reach: int) -> list[tuple[int, int]]:
    """The masks of the trees, and how far apart two fingerprints within reach can be under each in the tree that finds them."""
    return [(0xFFFFFFFF, reach // 2), (0xFFFFFFFF << 32, reach // 2)]


def divide(fps: np.ndarray, metrics: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
    """A vantage point, mask, radius and border that part fps with the least left to compare; None where none parts them.

    metrics: the mask and border to use, then those to go over to where the first do not help.
    """
    n = len(fps)
    for mask, border in metrics:
        best = (n * n, None)
        for v in fps[:: max(1, n // 8)][:8].tolist():
            below = np.cumsum(np.bincount(np.bitwise_count((fps ^ np.uint64(v)) & np.uint64(mask)), minlength=65 + border))
            left, right = below[border : 65 + border], n - below[:65]
            work = np.where(np.maximum(left, right) <= 0.9 * n, left * left + right * right, n * n)
            r = int(work.argmin())
            best = min(best, (int(work[r]), (v, mask, r, border)), key=lambda x: x[0])
        if best[1] and best[0] < n * n:
            return best[1]
    return None


def sides(fps: np.ndarray, at: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which fingerprints are on the left or in the border, and which on the right."""
    v, mask, radius, border = at
    d = np.bitwise_count((fps ^ np.uint64(v)) & np.uint64(mask))
    return d <= radius + border, d > radius


def grown(fps: np.ndarray, metrics: list[tuple[int, int]], leaf: int) -> list:
    """A tree as nested [place, left, right]; a leaf is []."""
    at = divide(fps, metrics) if len(fps) > leaf else None
    if at is None:
        return []
    left, right = sides(fps, at)
    return [at, grown(fps[left], metrics, leaf), grown(fps[right], metrics, leaf)]


def leaves(tree: list) -> int:
    return leaves(tree[1]) + leaves(tree[2]) if tree else 1


def dealt(tree: list, fps: np.ndarray) -> Iterator[np.ndarray]:
    """What of fps comes to each of the tree's leaves, from left to right."""
    if not tree:
        yield fps
        return
    left, right = sides(fps, tree[0])
    yield from dealt(tree[1], fps[left])
    yield from dealt(tree[2], fps[right])


def _deal(trees: dict[int, tuple[int, list]]):
    """Rows (shard, half, fp) to those of the new shards. trees: of a shard, the number of its first new shard and its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, half, fp = (batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "half", "fp"))
            for s in np.unique(shard).tolist():
                mine = shard == s
                first, tree = trees[s]
                for i, part in enumerate(dealt(tree, fp[mine].view(np.uint64))):
                    if len(part):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), first + i)), pa.array(np.full(len(part), half[mine][0])), pa.array(part.view(np.int64))], names=["shard", "half", "fp"])

    return run


def in_leaf(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within a leaf, as two arrays."""
    if len(fps) <= 4 * LEAF:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= reach
        if np.count_nonzero(near) == len(fps):
            return fps[:0], fps[:0]
        label, old = np.arange(len(fps)), None
        while old is None or (label != old).any():
            old = label
            label = np.where(near, label[None, :], len(fps)).min(axis=1)
            label = label[label]
        others = label != np.arange(len(fps))
        return fps[label[others]], fps[others]
    # what no tree parts is close together: each step reaches much of what is left, and only that is compared again
    a, b, left = [], [], fps
    while len(left):
        root, front, left = left[:1], left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[: max(1, (1 << 21) // len(left))], front[max(1, (1 << 21) // len(left)) :]
            hit = (np.bitwise_count(block[:, None] ^ left[None, :]) <= reach).any(axis=0)
            front, new, left = np.concatenate((front, left[hit])), left[hit], left[~hit]
            a.append(np.repeat(root, len(new)))
            b.append(new)
    return np.concatenate(a or [fps[:0]]), np.concatenate(b or [fps[:0]])


def in_shard(fps: np.ndarray, metrics: list[tuple[int, int]], reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = divide(fps, metrics) if len(fps) > LEAF else None
    if at is None:
        yield in_leaf(fps, reach)
        return
    for part in sides(fps, at):
        yield from in_shard(fps[part], metrics, reach)


def _search(reach: int):
    """Edges (u, v) of the shards; rows come sorted by shard."""

    def edges(half: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fps = np.unique(np.concatenate(parts)).view(np.uint64)
        found = list(in_shard(fps, [halves(reach)[half], (WHOLE, reach)], reach))
        u, v = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        if len(u):
            both = np.unique(np.stack((u, v), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            shard, half, fp = (batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "half", "fp"))
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for s, h, part in zip(np.split(shard, cuts), np.split(half, cuts), np.split(fp, cuts), strict=True):
                if len(s) == 0:
                    continue
                if now is not None and s[0] != now[0]:
                    yield from edges(now[1], parts)
                    parts = []
                now = (s[0], int(h[0]))
                parts.append(part)
        if parts:
            yield from edges(now[1], parts)

    return run


ROWS = "shard long, half int, fp long"


def near_pairs(fps: DataFrame, reach: int = 3) -> DataFrame:
    """Edges (u, v) that join the same fingerprints as all pairs within `reach` bits do. fps: a written table of distinct fp."""
    spark = fps.sparkSession
    n = fps.count()
    # the two trees begin as shards 0 and 1 that hold everything
    rows = fps.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), "fp").select(F.col("half").cast("long").alias("shard"), "half", "fp")
    open_, done, first = rows, [], 2
    chosen = fps.orderBy(F.xxhash64(F.lit(1), "fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    samples, sizes = {0: chosen, 1: chosen}, {0: n, 1: n}
    metric = {0: 0, 1: 1}
    while True:
        trees, whole = {}, []
        for s, sample in samples.items():
            fit = np.sort(sample.view(np.uint64))
            tree = grown(fit, [halves(reach)[metric[s]], (WHOLE, reach)], max(32, SHARD * len(fit) // max(1, sizes[s])))
            trees[s] = (first, tree)
            whole += [] if tree else [first]  # nothing parts it: such fingerprints lie in one small ball
            first += leaves(tree)
        new = written(open_.mapInArrow(_deal(trees), ROWS), "simhash-shards")
        large = {x["shard"]: (x["half"], x["count"]) for x in new.groupBy("shard", "half").count().filter(F.col("count") > LIMIT).collect() if x["shard"] not in whole}
        done.append(new.filter(~F.col("shard").isin(list(large))) if large else new)
        if not large:
            break
        # at most one shard for LIMIT rows is large, and they share one more sample
        open_ = new.filter(F.col("shard").isin(list(large)))
        share = min(1.0, SAMPLE / sum(c for _, c in large.values()))
        picked = open_.filter(F.pmod(F.xxhash64(F.lit(first), "fp"), F.lit(1 << 30)) < int(share * (1 << 30))).toPandas()
        samples = {s: picked["fp"][picked["shard"] == s].to_numpy(np.int64) for s in large}
        metric, sizes = {s: h for s, (h, _) in large.items()}, {s: c for s, (_, c) in large.items()}
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    return written(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search(reach), "u long, v long").distinct(), "simhash-edges")


def simhash_components(docs: DataFrame, k: int = 5, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fp (its 64 bits as a signed number) and component_id, the smallest id reachable by links.

    Two rows link when their fingerprints differ in at most `reach` bits. Null, empty and blank texts have fingerprint 0, which
    links like any other. Repeated rows stay as often as they are there. A null id is in its component but never its smallest,
    unless all are null. Very long texts are hashed whole; further columns are left out. An empty table gives an empty one.
    """
    marked = written(packed(docs, id_col, text_col).select("id", "text").mapInArrow(_fingerprints(k), "id long, fp long"), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    of = connected(near_pairs(distinct.select("fp"), reach)).toDF("fp", "root")
    rooted = written(distinct.join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(small(final), "fp").select("id", "fp", "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, reach=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
