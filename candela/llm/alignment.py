"""Alignment of two tokenizers over a corpus, with a dictionary of groups.

Tokens of A and B are byte ranges of the same text. The offsets where tokens of both end cut it into groups, which are the smallest
pieces that both tokenize alone. Most groups repeat very often, so each distinct one, as its A ids and B ids, is interned in a
dictionary: its links (pairs of tokens that overlap) are expanded once and multiplied by how often the group occurs. What the
counts of its links come to is again known per group, and is joined back by the group's key.

Texts are encoded by segments, which begin at a space after something that is not white space: neither tokenizer joins tokens
across that, and a task encodes each segment that it knows only once. Documents are gathered in blocks of bounded size; a block
ships each distinct group once, and a document is a list of numbers into its block's groups.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import packed, small, table, written

#: Characters of text after which a block is closed, and segments that a task remembers, with the longest such segment.
BLOCK, SEGMENTS, SEGMENT_CHARS = 1 << 24, 400_000, 64
#: Characters of text whose new segments are encoded at once.
STEP = 1 << 20
#: What byte-level vocabularies split text by before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space by any definition and what engines differ about; a segment must not begin after one of these.
ODD = r"\s\u180e\u200b-\u200f\u2060\ufeff"
CUT, RARE = re.compile(f"(?<=[^{ODD}])(?= [\\s\\S])"), re.compile(f"[{ODD}] ")
#: Characters beyond the Latin ones.
WIDE = re.compile("[^\x00-\u024f]")


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def ranks(a: str) -> dict[bytes, int] | None:
    """Bytes of a byte-level BPE's tokens and their ids, where ids follow its merges and it splits by its usual pattern alone; else None."""
    d, decode = json.loads(a), byte_level()
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = not d.get("normalizer") and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or not usual or any(model["vocab"].get(x + y) != 256 + n for n, (x, y) in enumerate(merges)) or any(model["vocab"].get(c, 256) > 255 for c in decode):
        return None
    return {bytes(decode[c] for c in t): i for t, i in model["vocab"].items() if all(c in decode for c in t) and i < 256 + len(merges)}


class Pair:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, a: str, b: bytes) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        # the same merges by a faster library, for characters whose classes no version of Unicode has changed
        known = ranks(a)
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}) if known else None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        decode, vocab = byte_level(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(decode[c] for c in token) if all(c in decode for c in token) else token.encode()
        n = self.b.get_piece_size()
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]
        self.len_a, self.len_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space + text by A and of text by B, which adds the space itself; None where their bytes are not those of space + text."""
        want = f" {text}".encode()
        if self.fast and not WIDE.search(text):
            a = self.fast.encode_ordinary(f" {text}")
        else:
            a = self.a.encode(f" {text}", add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if same else None

    def cuts(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each group: the byte where it ends, and the numbers of A and B tokens up to there."""
        ends, at_a, at_b = np.intersect1d(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]), assume_unique=True, return_indices=True)
        return ends, at_a + 1, at_b + 1


def links(len_a: list[int], len_b: list[int]) -> list[tuple[int, int]]:
    """The places of A and B tokens of a group that overlap, from their lengths in bytes."""
    out, i, j, end_a, end_b = [], 0, 0, len_a[0], len_b[0]
    while True:
        out.append((i, j))
        if end_a == end_b:
            return out  # nothing else ends together within a group
        if end_a < end_b:
            i += 1
            end_a += len_a[i]
        else:
            j += 1
            end_b += len_b[j]


class Grown:
    """An array that grows at its end."""

    def __init__(self) -> None:
        self.held, self.n = np.empty(1 << 12, np.int64), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.empty(self.n + len(x) + (1 << 12), np.int64)))
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)


class Segments:
    """What a task knows: the groups by number, and segments as lists of groups."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.packs = max(len(pair.len_a), len(pair.len_b)) <= 1 << 16
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ends = Grown()  # of each segment, where its groups end in `flat`
        self.flat = Grown()
        self.groups: dict[str, int] = {}
        self.packed: dict[int, int] = {}
        self.keys: list[str] = []
        self.n_a, self.n_b = Grown(), Grown()  # tokens of each group
        self.size = 0

    def _group(self, a: list[int], b: list[int]) -> int:
        key = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        g = self.groups.get(key)
        if g is None:
            g = self.groups[key] = len(self.keys)
            self.keys.append(key)
            self.n_a.add(np.array([len(a)]))
            self.n_b.add(np.array([len(b)]))
            self.size += len(key) + 200
        return g

    def _intern(self, a: list[int], b: list[int], at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """The numbers of the groups that end at these numbers of A and B tokens. Groups of three tokens or fewer are told apart as one number each."""
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        i, j = np.concatenate(([0], at_a[:-1])), np.concatenate(([0], at_b[:-1]))
        n_a, n_b = at_a - i, at_b - j
        short = (n_a + n_b <= 3) & self.packs
        out = np.empty(len(at_a), np.int64)
        if short.any():
            p, q, two_a, two_b = i[short], j[short], n_a[short] == 2, n_b[short] == 2
            first_b, none = y[q] + (1 << 16), (1 << 17) - 1
            second = np.where(two_a, x[np.minimum(p + 1, len(x) - 1)], first_b)
            third = np.where(two_b, y[np.minimum(q + 1, len(y) - 1)] + (1 << 16), np.where(two_a, first_b, none))
            codes, one, place = np.unique((x[p] << 34) | (second << 17) | third, return_index=True, return_inverse=True)
            where = np.flatnonzero(short)
            found = []
            for code, k in zip(codes.tolist(), where[one].tolist(), strict=True):
                g = self.packed.get(code)
                if g is None:
                    g = self.packed[code] = self._group(a[i[k] : at_a[k]], b[j[k] : at_b[k]])
                found.append(g)
            out[short] = np.array(found, np.int64)[place]
        for k in np.flatnonzero(~short).tolist():
            out[k] = self._group(a[i[k] : at_a[k]], b[j[k] : at_b[k]])
        return out

    def _put(self, segments: list[str], groups: np.ndarray, ends: np.ndarray) -> None:
        """Segments whose groups end at `ends` of groups."""
        n = self.ends.n
        self.ends.add(self.flat.n + ends)
        self.flat.add(groups)
        self.number.update(zip(segments, range(n, n + len(segments)), strict=True))

    def _all(self, segments: list[str]) -> bool:
        """Encodes segments as one text; whether that could be done."""
        found = self.pair.encode(" ".join(segments))
        if found is None:
            return False
        ends, at_a, at_b = self.pair.cuts(*found)
        at = np.searchsorted(ends, np.cumsum([len(s.encode()) + 1 for s in segments])) + 1
        self._put(segments, self._intern(*found, at_a, at_b), at)
        return True

    def learn(self, new: list[str]) -> set[str]:
        """Encodes segments, as one text where that is the same; returns those whose bytes a tokenizer changes."""
        plain, wide, alone = [], [], []
        for s in new:
            (alone if not s or RARE.search(s[-1] + " ") else wide if WIDE.search(s) else plain).append(s)
        for some in (plain, wide):
            if some and not self._all(some):
                alone += some
        return {s for s in alone if not self._all([s])}

    def of(self, segments: list[str]) -> np.ndarray:
        """The groups of segments, in order."""
        at = np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))
        ends = self.ends.held
        first = np.where(at > 0, ends[at - 1], 0)
        sizes = ends[at] - first
        before = np.cumsum(sizes) - sizes
        return self.flat.held[np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))]


def parts(text: str) -> list[str]:
    """The segments of space + text, each without the space that it begins with; none is empty, since B adds its space to some text only."""
    if "  " not in text and text[0] != " " and text[-1] != " " and (not RARE.search(text) if not text.isascii() else not any(x in text for x in ("\n ", "\t ", "\r ", "\x0b ", "\x0c ", "\x1c ", "\x1d ", "\x1e ", "\x1f "))):
        return text.split(" ")
    return [s[1:] for s in CUT.split(f" {text}")]


ROWS = "block long, k long, grp string, f long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, times binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]


def _blocks(a: str, b: bytes):
    """Documents to rows of their block's groups (k, grp, f: how often) and of documents, whose held are numbers k with their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Segments(Pair(a, b))
        block = TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        chars = 0

        def close() -> Iterator[pa.RecordBatch]:
            """The groups of the block, then its documents, in batches."""
            everything = np.concatenate([g for g, _ in held] or [np.empty(0, np.int64)])
            used, places = np.unique(everything, return_inverse=True)
            f = np.bincount(places, np.concatenate([n for _, n in held] or [np.empty(0)]), len(used)).astype(np.int64)
            for i in range(0, len(used), 1 << 16):
                g = used[i : i + (1 << 16)]
                cols = {"block": np.full(len(g), block), "k": np.arange(i, i + len(g)), "grp": [known.keys[x] for x in g.tolist()], "f": f[i : i + (1 << 16)]}
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(len(g), t) for c, t in zip(NAMES, KINDS, strict=True)], names=NAMES)
            ends = np.cumsum([len(g) for g, _ in held]).tolist()
            for i in range(0, len(docs), 1024):
                some = docs[i : i + 1024]
                lists = [(places[e - len(g) : e].astype(np.int32).tobytes(), n.astype(np.int32).tobytes()) for e, (g, n) in zip(ends[i : i + 1024], held[i : i + 1024], strict=True)]
                cols = dict(zip(NAMES[4:], zip(*(d + x for d, x in zip(some, lists, strict=True)), strict=True), strict=True)) | {"block": [block] * len(some)}
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(len(some), t) for c, t in zip(NAMES, KINDS, strict=True)], names=NAMES)

        def put(some: list[tuple], cut: list[list[str]]) -> None:
            """Documents (id, text) and their segments into the block; what is new is learnt at once."""
            new = set().union(*cut) - known.number.keys()
            bad = known.learn(list(new)) if new else set()
            for (i, text), segments in zip(some, cut, strict=True):
                if not text or (bad and not bad.isdisjoint(segments)):
                    docs.append((i, 0, 0, 0, 0, ""))
                    held.append((np.empty(0, np.int64), np.empty(0, np.int64)))
                    continue
                groups = known.of(segments)
                n_a, n_b = int(known.n_a.held[groups].sum()), int(known.n_b.held[groups].sum())
                sha = hashlib.sha256(";".join(map(known.keys.__getitem__, groups.tolist())).encode()).hexdigest()
                # each link but a group's first begins where a token of either ends
                docs.append((i, n_a, n_b, len(groups), n_a + n_b - len(groups), sha))
                held.append(np.unique(groups, return_counts=True))
            for s in new:
                if len(s) > SEGMENT_CHARS:
                    known.number.pop(s, None)

        for batch in batches:
            some, cut, size = [], [], 0
            rows = list(zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True))
            for n, (i, text) in enumerate(rows):
                some.append((i, text))
                cut.append(parts(text) if text else [])
                size += len(text or "") + 100
                if size < STEP and n + 1 < len(rows):
                    continue
                put(some, cut)
                chars += size
                some, cut, size = [], [], 0
                full = known.ends.n > SEGMENTS or known.size > 64 << 20
                if chars >= BLOCK or full:
                    yield from close()
                    block, docs, held, chars = block + 1, [], [], 0
                if full:
                    known.clear()
        if docs:
            yield from close()

    return run


def _links(a: str, b: bytes):
    """Of each distinct group its links (tok_a, tok_b), n of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(a, b)
        len_a, len_b = pair.len_a.tolist(), pair.len_b.tolist()
        for batch in batches:
            keys, xs, ys, ns = [], [], [], []
            for key in batch["grp"].to_pylist():
                ids_a, ids_b = ([int(x) for x in side.split(",")] for side in key.split("|"))
                found: dict[tuple[int, int], int] = {}
                for i, j in links([len_a[x] for x in ids_a], [len_b[x] for x in ids_b]):
                    found[ids_a[i], ids_b[j]] = found.get((ids_a[i], ids_b[j]), 0) + 1
                for (x, y), n in found.items():
                    keys.append(key)
                    xs.append(x)
                    ys.append(y)
                    ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(xs, pa.int32()), pa.array(ys, pa.int32()), pa.array(ns, pa.int64())], names=["grp", "tok_a", "tok_b", "n"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, a block's groups by k before its documents."""
    now, best, total = None, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        block, has = batch["block"].to_numpy(), batch["k"].is_valid().to_numpy(zero_copy_only=False)
        n_best, count_sum = (batch[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("n_best", "count_sum"))
        held, times = batch["held"], batch["times"]
        mine_best, mine_sum = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(has.astype(np.int8)) != 0)) + 1).tolist(), len(block)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if block[i] != now:
                now, best, total = block[i], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            if has[i]:
                best.append(n_best[i:j])
                total.append(count_sum[i:j])
                continue
            best, total = [np.concatenate(best)], [np.concatenate(total)]
            for r in range(i, j):
                k, n = np.frombuffer(held[r].as_buffer(), np.int32), np.frombuffer(times[r].as_buffer(), np.int32).astype(np.int64)
                mine_best[r], mine_sum[r] = (best[0][k] * n).sum(), (total[0][k] * n).sum()
        docs = pa.array(~has)
        cols = {c: batch[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(mine_best), "count_sum": pa.array(mine_sum), "groups_sha256": batch["groups_sha256"]}
        yield pa.RecordBatch.from_pydict(cols).filter(docs)


class Alignment:
    """The alignment of A (tokenizers .json) and B (sentencepiece .model) over docs; paths are the driver's."""

    def __init__(self, docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> None:
        own = Path(a).read_text(encoding="utf-8"), Path(b).read_bytes()
        self.rows = written(packed(docs, id_col, text_col).select("id", "text").mapInArrow(_blocks(*own), ROWS), "align-blocks")
        placed = self.rows.filter("grp IS NOT NULL").select("block", "k", "grp", "f")
        self.placed = placed
        #: grp (its ids as `a1,a2|b1`), f: how often it occurs
        self.groups = written(placed.groupBy("grp").agg(F.sum("f").alias("f")), "align-groups")
        #: grp, tok_a, tok_b, n: the links of a group
        self.links = written(self.groups.select("grp").mapInArrow(_links(*own), "grp string, tok_a int, tok_b int, n long"), "align-links")
        weighed = self.links.join(self.groups, "grp").groupBy("tok_a", "tok_b").agg(F.sum(F.col("n") * F.col("f")).alias("count"))
        weighed = written(weighed, "align-counts")
        top = weighed.groupBy("tok_b").agg(F.max("count").alias("top"))
        #: tok_a, tok_b, count: how many links hold the pair; best: no A id is linked to this B id more often
        self.pairs = written(weighed.join(top, "tok_b").select("tok_a", "tok_b", "count", (F.col("count") == F.col("top")).alias("best")), "align-pairs")

    def documents(self) -> DataFrame:
        """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs."""
        known = self.links.join(small(self.pairs), ["tok_a", "tok_b"])
        worth = known.groupBy("grp").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
        worth = written(worth, "align-worth")
        back = self.placed.join(worth, "grp").select("block", "k", "n_best", "count_sum")
        docs = self.rows.filter("grp IS NULL").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "times")
        both = back.unionByName(docs, allowMissingColumns=True).repartition("block").sortWithinPartitions(F.col("block"), F.col("k").asc_nulls_last())
        return both.mapInArrow(_sums, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a and n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes space + text, B text, both without special tokens. An id pair's count is how many links hold it in the corpus; n_best
    are the links whose count is the highest of their B id, ties included; count_sum adds up the counts of all links.
    groups_sha256 is of the groups in order, as `a1,a2|b1;a3|b2,b3`. Texts that are null or empty, or whose bytes a tokenizer
    changes (U+2581, which B takes for a space), have no tokens: zeros and an empty string. Repeated rows count as often as
    they are there, rows without an id too. Very long texts are encoded whole; further columns are left out. An empty table
    gives an empty one.
    """
    return Alignment(docs, a, b, id_col, text_col).documents()


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return aligned(docs, *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))).withColumnRenamed("id", "doc_id")
