"""Removal of byte strings that repeat across or within documents, by sorting suffixes.

A suffix array of a corpus is one object; this is its work cut into pieces that Spark can deal out. The anchor of a string of
`length` bytes is the place in it whose hash of the next CONTEXT bytes is smallest. Equal strings have the same anchor, so
suffixes need to be sorted only at anchors, and only among anchors with equal contexts. An anchor's slice is the bytes of the
strings that it is the anchor of. Short contexts recur by chance, the more so the larger the corpus. So a string's anchor lies in
the one or the other half of its possible places, and for each half there is a piece of bytes around the anchor that all strings
of that half hold: only anchors with an equal piece are sorted together. Per piece, deep-shallow sorting orders the texts after the anchors: multikey quicksort to
a shallow depth, then a blind trie for each group whose common prefix goes deeper. The texts before the anchors are sorted the
same way, reversed. The two orders and their common prefixes tell which strings occur elsewhere.

A piece with very many different slices is split by further bytes. All its slices are compared with one of them, the
leader. Two slices that agree further with each other than with the leader, on one side of the anchor, part from the leader at
the same byte there and go on alike; so the slices are dealt out twice, by the byte at which they part before the anchor and by
that after it, and such groups are sorted, or split again. What two slices share without either is no more than each shares
with the leader.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.llm.common import discard, hash128, packed, table, unpacked, with_rest, written

LENGTH, CONTEXT = 400, 32
#: Repeated strings from this length on are reported too, but not removed: passages of 50 words or so.
PASSAGE = 256
#: The depth in bytes to which multikey quicksort goes before blind tries take over, and the bytes it compares at once.
SHALLOW, STEP = 64, 8
#: Slices that are sorted together at most; larger groups are split.
GROUP = 2048


# ---- anchors


def anchors(data: bytes, lengths: tuple[int, ...] = (LENGTH,), context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """Places of the anchors, 64-bit hashes of their contexts, and where their slices start and end.

    Each string of one of the lengths is in the slice of its anchor. The shortest length comes first: the anchors of longer
    strings are among those of the shortest.
    """
    if len(data) < lengths[0]:
        return (np.empty(0, np.int64),) * 4
    n = len(data) - context + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, context, 8):
            h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    # hash above, place below: the smallest of a window is unique, the leftmost of equals, and never moves left
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    at = start = end = None
    for length in lengths:
        if len(data) < length:
            break
        owner = (_window_min(keys, length - context + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        if at is None:
            at, start, end = owner[first], first.copy(), last + length
        else:
            i = np.searchsorted(at, owner[first])
            start[i], end[i] = np.minimum(start[i], first), np.maximum(end[i], last + length)
    return at, h[at].view(np.int64), start, end


def _window_min(keys: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each run of `window` keys: prefix and suffix minima of blocks."""
    n = len(keys)
    full = np.full(-(-n // window) * window, np.uint64(2**64 - 1))
    full[:n] = keys
    blocks = full.reshape(-1, window)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - window + 1], left[window - 1 : n])


def pieces(length: int, context: int) -> list[tuple[int, int]]:
    """Bytes before an anchor and from it on that two anchors have in common if a string of `length` bytes around them is the
    same: one piece for the strings that start close before the anchor, one for those that start further before it."""
    most = length - context
    half = most // 2 + 1
    return [(0, length - half + 1), (half, context)]


# ---- deep-shallow sorting


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of a and b."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of the strings: multikey quicksort on STEP bytes at a time up to `shallow`, then blind tries."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            out += blind_trie(strings, group)
        else:
            key = [strings[i][depth : depth + STEP] for i in group]
            pivot = key[len(key) // 2]
            less = [i for i, k in zip(group, key, strict=True) if k < pivot]
            same = [i for i, k in zip(group, key, strict=True) if k == pivot]
            more = [i for i, k in zip(group, key, strict=True) if k > pivot]
            if more:
                todo.append((more, depth))
            if len(pivot) < STEP:
                todo += [([i], depth) for i in reversed(same)]  # they end here, so they are equal
            else:
                todo.append((same, depth + STEP))
            if less:
                todo.append((less, depth))
    return out


def blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """The order of a group with a long common prefix. Inner nodes hold only the depth at which their branches differ.

    A string goes down the trie by the bytes at those depths, unseen bytes in between; one comparison with any string
    below then tells where it leaves, and the way down is cut there.
    """
    root: list = [-1, group[0], {}]  # depth, leaf or any string below, branches by byte (-1: the string ends)
    leaf = lambda i: [-1, i, {}]
    equal: dict[int, list[int]] = {}
    for i in group[1:]:
        s, node, path = strings[i], root, [root]
        while node[2]:
            node = node[2].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[2].values()))
            path.append(node)
        depth = common(s, strings[node[1]])
        if depth == len(s) == len(strings[node[1]]):
            equal.setdefault(node[1], []).append(i)
            continue
        at = next(x for x in path if not x[2] or x[0] >= depth)
        if at[2] and at[0] == depth:
            at[2][s[depth] if depth < len(s) else -1] = leaf(i)
            continue
        other, old = strings[node[1]], [at[0], at[1], at[2]]
        at[:] = [depth, at[1], {other[depth] if depth < len(other) else -1: old, s[depth] if depth < len(s) else -1: leaf(i)}]
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node[2]:
            todo += [node[2][k] for k in sorted(node[2], reverse=True)]
        else:
            out += [node[1], *equal.get(node[1], ())]
    return out


# ---- what repeats around the anchors of one piece


def covered(slices: list[tuple[bytes, bytes, int]], length: int = LENGTH, passage: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """For each distinct (text before, text after, occurrences): bytes before and after the anchor that strings of `length`
    bytes repeat, and the same for strings of `passage` bytes, which are no longer; zeros where none do.

    A string that starts l bytes before the anchor and ends r bytes after it repeats if another slice agrees so far on both
    sides. Neighbours in the order of the reversed texts before are visited outwards, with falling l, until no string can
    be long enough or none can reach further right than the neighbours in the order of the texts after allow.
    """
    lefts, rights = [x[0][::-1] for x in slices], [x[1] for x in slices]
    right_order, left_order = deep_shallow(rights), deep_shallow(lefts)
    most = [0] * len(slices)
    for a, b in zip(right_order, right_order[1:]):
        n = common(rights[a], rights[b])
        most[a], most[b] = max(most[a], n), max(most[b], n)
    shared = [common(lefts[a], lefts[b]) for a, b in zip(left_order, left_order[1:])]
    out: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)] * len(slices)
    for place, s in enumerate(left_order):
        if slices[s][2] > 1:  # the whole slice is elsewhere too
            whole = len(lefts[s]), len(rights[s])
            out[s] = (*(whole if sum(whole) >= length else (0, 0)), *whole)
            continue
        lo = hi = low = high = 0
        up = down = place
        l_up = shared[up - 1] if up else -1
        l_down = shared[down] if down < len(shared) else -1
        while (l := max(l_up, l_down)) + most[s] >= passage and l >= 0:
            if l_up >= l_down:
                up -= 1
                b = left_order[up]
                l_up = min(l_up, shared[up - 1]) if up else -1
            else:
                down += 1
                b = left_order[down]
                l_down = min(l_down, shared[down]) if down < len(shared) else -1
            r = common(rights[s], rights[b])
            if l + r >= passage:
                low, high = max(low, l), max(high, r)
                if l + r >= length:
                    lo, hi = max(lo, l), max(hi, r)
                if r == most[s]:
                    break
        out[s] = (lo, hi, low, high)
    return out


# ---- the tasks


ANCHORS = "k1 long, k2 long, pos long, more array<long>, ctx long, s1 long, s2 long, lb long, la long, p1 long, p2 long"
#: A slice is known by the first place where it is.
SLICE = ["k1", "k2", "pos"]


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [pa.binary() if x.endswith("binary") else pa.int64() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_fields(schema))


def _anchors(lengths: tuple[int, ...], context: int):
    """Each slice of a text with its anchor, the further places where the text has it (null: none), a 128-bit hash of it and of the
    anchor's place in it, and hashes of its pieces (null: not in the slice)."""
    around = pieces(lengths[0], context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(10)]
            missing: list[list] = [[], []]
            further: list = []
            for k1, k2, text in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "text")), strict=True):
                data = (text or "").encode()
                at, ctx, start, end = anchors(data, lengths, context)
                view = memoryview(data)
                digests = [xxhash.xxh3_128_digest(view[a:b], x) for a, b, x in zip(start.tolist(), end.tolist(), (at - start).tolist(), strict=True)]
                more: list = [None] * len(at)
                if len(set(digests)) < len(at):
                    places: dict[bytes, list[int]] = {}
                    for i, x in enumerate(digests):
                        places.setdefault(x, []).append(i)
                    own = [x[0] for x in places.values()]
                    more = [at[x[1:]].tolist() if len(x) > 1 else None for x in places.values()]
                    at, ctx, start, end = (x[own] for x in (at, ctx, start, end))
                    digests = list(places)
                s = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                hashes = []
                for side, (before, after) in enumerate(around):
                    first, last = at - before, at + after
                    inside = (start <= first) & (last <= end)
                    missing[side].append(~inside)
                    hashes.append(np.zeros(len(at), np.int64))
                    hashes[-1][inside] = np.frombuffer(b"".join([xxhash.xxh3_64_digest(view[a:b], side) for a, b in zip(first[inside].tolist(), last[inside].tolist(), strict=True)]), "<i8")
                for col, x in zip(cols, (np.full(len(at), k1), np.full(len(at), k2), at, ctx, s[:, 0], s[:, 1], at - start, end - at, *hashes), strict=True):
                    col.append(x)
                further += more
            masks = [None] * 8 + [np.concatenate(x) if x else None for x in missing]
            arrays = [pa.array(np.concatenate(c) if c else [], pa.int64(), mask=m) for c, m in zip(cols, masks, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:3], pa.array(further, pa.list_(pa.int64())), *arrays[3:]], names=_fields(ANCHORS))

    return run


#: g1, g2: slices with equal ones are sorted together.
SLICES = "g1 long, g2 long, k1 long, k2 long, pos long, n long, before binary, after binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for k1, k2, text, found in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "text", "found")), strict=True):
            data = text.encode()
            for x in found:
                at = x["pos"]
                rows.append((x["piece"], 0, k1, k2, at, x["n"], data[at - x["lb"] : at], data[at : at + x["la"]]))
            if len(rows) >= 8192:
                yield _rows(rows, SLICES)
                rows = []
        if rows:
            yield _rows(rows, SLICES)


COVER = "k1 long, k2 long, pos long, lo long, hi long, low long, high long"


def _cover(length: int, passage: int):
    """Rows sorted by g1, g2; a group's slices can be spread over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                own = list({x[2:5]: x for x in held}.values())
                found = covered([(x[6], x[7], x[5]) for x in own], length, passage)
                done.extend((*x[2:5], *y) for x, y in zip(own, found, strict=True) if y[3] and x[5] == 1)

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in _fields(SLICES)), strict=True):
                if held and held[0][:2] != row[:2]:
                    close()
                    held = []
                held.append(row)
            if len(done) > 4096:
                yield _rows(done, COVER)
                done = []
        close()
        if done:
            yield _rows(done, COVER)

    return run


SPLIT = SLICES + ", side long, lo long, hi long, low long, high long"


def _against_leader(length: int, passage: int):
    """Rows with a slice and its group's leader (l1, l2, l3, ln, l_before, l_after).

    side 0: what the slice shares with the leader, and the leader with its slices; side 1, 2: the slice in its group by the
    byte at which it parts from the leader before or after the anchor.
    """

    def spans(l: int, r: int) -> tuple[int, int, int, int]:
        return (*((l, r) if l + r >= length else (0, 0)), *((l, r) if l + r >= passage else (0, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            leaders: dict[tuple, tuple] = {}
            for g1, g2, k1, k2, pos, n, before, after, l1, l2, l3, ln, l_before, l_after in zip(*(batch[c].to_pylist() for c in (*_fields(SLICES), "l1", "l2", "l3", "ln", "l_before", "l_after")), strict=True):
                if (k1, k2, pos) == (l1, l2, l3):
                    continue
                l, r = common(before[::-1], l_before[::-1]), common(after, l_after)
                found = spans(l, r)
                if found[3]:
                    if n == 1:
                        rows.append((0, 0, k1, k2, pos, n, None, None, 0, *found))
                    if ln == 1:
                        leaders[l1, l2, l3] = tuple(map(max, found, leaders.get((l1, l2, l3), found)))
                for side, depth, byte in ((1, l, before[-1 - l : len(before) - l]), (2, r, after[r : r + 1])):
                    if byte:
                        d = xxhash.xxh3_128_intdigest(b"%d %d %d %d %d" % (g1, g2, side, depth, byte[0]))
                        rows.append(((d >> 64) - 2**63, d % 2**64 - 2**63, k1, k2, pos, n, before, after, side, 0, 0, 0, 0))
                if len(rows) >= 8192:
                    yield _rows(rows, SPLIT)
                    rows = []
            rows += [(0, 0, *k, 1, None, None, 0, *v) for k, v in leaders.items()]
            if rows:
                yield _rows(rows, SPLIT)

    return run


def _sorted_groups(slices: DataFrame, length: int, passage: int) -> DataFrame:
    return slices.select(*_fields(SLICES)).repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(_cover(length, passage), COVER)


def _crowded(slices: DataFrame, length: int, passage: int, group: int) -> DataFrame:
    """The cover of distinct slices of groups with more than `group` of them. Each round, slices share a byte more at least."""
    todo, parts, used = slices, [], []
    while True:
        sizes = written(todo.groupBy("g1", "g2").agg(F.count("*").alias("slices"), F.min(F.struct(*SLICE)).alias("lead")).filter("slices > 1"), "suffix-sizes")
        used.append(sizes)
        several = todo.join(sizes, ["g1", "g2"])
        parts.append(_sorted_groups(several.filter(F.col("slices") <= group), length, passage))
        if sizes.filter(F.col("slices") > group).isEmpty():
            break
        big = written(several.filter(F.col("slices") > group), "suffix-big")
        leads = big.filter(F.struct(*SLICE) == F.col("lead"))
        leads = written(leads.select("g1", "g2", F.col("k1").alias("l1"), F.col("k2").alias("l2"), F.col("pos").alias("l3"), F.col("n").alias("ln"), F.col("before").alias("l_before"), F.col("after").alias("l_after")), "suffix-leaders")
        split = written(big.select(*_fields(SLICES)).join(leads, ["g1", "g2"]).mapInArrow(_against_leader(length, passage), SPLIT), "suffix-split")
        parts.append(split.filter("side = 0").select(*_fields(COVER)))
        used += [big, leads, split]
        todo = split.filter("side > 0").select(*_fields(SLICES))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = written(out.groupBy(*SLICE).agg(*(F.max(c).alias(c) for c in ("lo", "hi", "low", "high"))), "suffix-crowded")
    discard(*used)
    return out


def repeats(docs: DataFrame, length: int = LENGTH, passage: int | None = None, context: int = CONTEXT, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs in the form of packed() with `spans`, byte runs that repeated strings of `length` bytes cover, and
    `passages`, runs that repeated strings of `passage` bytes cover (at most length; None: the same); sorted, overlapping (null: none).

    Texts are UTF-8 bytes, null is empty; matches never cross rows; a string repeats if it starts anywhere else, in the same
    text too. Rows with equal id and text count as that many texts. An empty table gives an empty one. Lengths must be at
    least context + 8, context a multiple of 8. Very long texts are whole as all others; further columns are in `rest`.
    """
    passage = passage or length
    if context % 8 or not context + 8 <= passage <= length:
        raise ValueError("context must be a multiple of 8, and context + 8 <= passage <= length")
    lengths = (passage, length) if passage < length else (length,)
    k1, k2 = hash128(F.col("id"), F.col("text"))
    rows = packed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumns({"k1": k1, "k2": k2})
    every = rows.select("k1", "k2", "text").mapInArrow(_anchors(lengths, context), ANCHORS).repartition("ctx")
    # equal slices and equal pieces are at equal contexts, so one shuffle serves all counts; a text has a row a slice
    alike = lambda *c: W.partitionBy("ctx", *c)
    places = F.when(F.col("more").isNull(), 1).otherwise(1 + F.size("more"))
    every = every.withColumns({"n": F.sum(places).over(alike("s1", "s2")), "first": F.row_number().over(alike("s1", "s2").orderBy(*SLICE)) == 1})
    every = every.withColumns({f"m{i}": F.when(F.col(f"p{i}").isNotNull(), F.sum(F.col("first").cast("int")).over(alike(f"p{i}"))) for i in (1, 2)})
    found = written(every.filter("n > 1 or m1 > 1 or m2 > 1").drop("ctx", "s1", "s2"), "suffix-found")
    # each slice once for each of its pieces that different slices have
    uncertain = found.filter("first").select(*SLICE, "n", "lb", "la", F.inline(F.array(*(F.struct(F.col(f"p{i}").alias("piece"), F.col(f"m{i}").alias("slices")) for i in (1, 2))))).filter("slices > 1")

    def with_bytes(which: DataFrame) -> DataFrame:
        wanted = which.groupBy("k1", "k2").agg(F.collect_list(F.struct("piece", "n", "pos", "lb", "la")).alias("found"))
        # a row of docs that is there more than once gives its slices as often
        return rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).mapInArrow(_slices, SLICES)

    cover = _sorted_groups(with_bytes(uncertain.filter(F.col("slices") <= group)), length, passage)
    crowded, crowd = uncertain.filter(F.col("slices") > group), []
    if not crowded.isEmpty():
        many = written(with_bytes(crowded).dropDuplicates(["g1", *SLICE]), "suffix-crowd")
        crowd = [many, _crowded(many, length, passage, group)]
        cover = cover.unionByName(crowd[1])
    cover = written(cover, "suffix-cover")
    discard(*crowd)
    # a slice that occurs twice is covered whole; of the others, what covered() or the leaders have found
    long = F.when(F.col("lb") + F.col("la") >= length, 1).otherwise(0)
    every_place = F.explode(F.concat(F.array("pos"), F.coalesce("more", F.array().cast("array<long>")))).alias("pos")
    known = found.filter("n > 1").select("k1", "k2", every_place, (long * F.col("lb")).alias("lo"), (long * F.col("la")).alias("hi"), F.col("lb").alias("low"), F.col("la").alias("high"))

    def runs(left: str, right: str):
        run = F.struct((F.col("pos") - F.col(left)).alias("start"), (F.col("pos") + F.col(right)).alias("end"))
        return F.array_sort(F.collect_set(F.when(F.col(right) > 0, run)))

    spans = cover.unionByName(known).groupBy("k1", "k2").agg(runs("lo", "hi").alias("spans"), runs("low", "high").alias("passages"))
    return rows.join(spans, ["k1", "k2"], "left").select("id", "text", "rest", "spans", "passages")


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in spans or ():
        if out and x["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["end"]))
        else:
            out.append((x["start"], x["end"]))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for text, spans, passages in zip(*(batch[c].to_pylist() for c in ("text", "spans", "passages")), strict=True):
            data, at, kept = text.encode(), 0, []
            runs = _merged(spans)
            for start, end in runs:
                kept.append(data[at:start])
                at = end
            left = b"".join([*kept, data[at:]])
            for c, x in zip(cols, (left.decode(errors="replace"), len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), sum(b - a for a, b in _merged(passages))), strict=True):
                c.append(x)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch["id"], batch["rest"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "rest", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"])


def cut(found: DataFrame) -> DataFrame:
    """The rows of repeats() with what is left of their texts, and figures and hash of it."""
    return found.mapInArrow(_cut, with_rest(found, "text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the bytes in repeated strings; null texts become empty, a character that was cut into U+FFFD."""
    return unpacked(cut(repeats(docs, length, id_col=id_col, text_col=text_col, **how)), docs, id_col, text_col)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_repeated: bytes in repeated strings of PASSAGE bytes, which stay where none of LENGTH bytes covers them."""
    found = cut(repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")
