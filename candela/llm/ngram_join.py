"""Jaccard self-join of documents on word shingles by prefixes of token combinations.

A token is a shingle's hash; a global order puts rare tokens before frequent ones, and orders each class by hash. A set of n
tokens shares at least ceil(t n) of them with any partner, so it can miss tau = n - ceil(t n). Its prefix holds rare tokens
until there are tau + 1 of them; if there are not so many it is extended by frequent tokens, of which one more is needed.
Partners then share a rare token of their prefixes or a pair of frequent ones: rare tokens are indexed singly, frequent ones
as 2-token combinations. Candidates are verified on whole shingle sets.

Groups of copies would pair all with all. So sets are first linked to leaders: of the sets with an equal minimum hash the one
whose minimum hashes are the most common, which in a group of altered copies is close to the original. Links are verified,
and what hangs together by them is a cluster, represented by the member with the most links. The index joins clusters, not
their members: a token is one row for a cluster, and a token is frequent if many clusters hold it. No link between clusters is
lost, and inside a cluster none changes a component. Pairs that miss narrowly are ruled out in the join itself: a bit for the
parity of the tokens of each of BITS classes bounds from below how far two sets differ, and the members' largest distance from
their representative how far members do.

Representatives of joined clusters are verified first. Where they are not similar but members could be, only tokens decide,
not texts. Let P and Q be the usual tokens of two clusters (the representative's, less those that most members lack, and those
that most have instead), I what P and Q share, and let members a and b lack la and lb of them and have oa and ob others. With
ya of the oa in Q - P, ea of the la in P - Q (yb, eb alike) and x tokens in both oa and ob, a and b share at most
I + ya + yb + x - max(la - ea, lb - eb) tokens. So 100 shared - percent union is at most a sum of what a gives, what b gives
and what x gives, less what P and Q miss the threshold by. A member that differs from P where Q does not gives less than
nothing: only members that reach the sum with the other cluster's best are paired, and only pairs that reach it are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import hash128, packed, small, table, unpacked, written

#: Minimum hashes by which leaders are found. They bound the work, not the result.
LEADERS = 16
#: Parity bits of a set, which bound the difference of two sets from below.
BITS = 1024
#: A token in more clusters than this is frequent, as long as there are at most MOST_FREQUENT of them; if not, the threshold rises.
FREQUENT, MOST_FREQUENT = 32, 1 << 20
#: Numbers that the first half of a set's 128-bit identity can have.
SIDS = 1 << 64


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of fewer words, one of them all; without words, none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z, and \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = (h ^ w[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def misses(n: int, percent: int) -> int:
    """How many of n tokens a partner of any size can lack."""
    return n - -(-percent * n // 100)


SETS = "id long, k1 long, k2 long, n long, sid long, sid2 long, keys array<long>, head array<long>, bits array<long>"


def _sets(k: int, percent: int):
    salts = np.array([(2 * s + 1) * 0xD6E8FEB86659FD93 % 2**64 for s in range(1, LEADERS + 1)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                n, sid, sid2, keys, head, bits = [], [], [], [], [], []
                for text in batch["text"].to_pylist():
                    x = shingles(text, k)
                    n.append(len(x))
                    d = xxhash.xxh3_128_intdigest(x.tobytes())
                    sid.append((d >> 64) % SIDS - 2**63)
                    sid2.append(d % 2**64 - 2**63)
                    u = x.view(np.uint64)
                    keys.append(np.array([(u * s).min() for s in salts], np.uint64).view(np.int64) if len(x) else x)
                    bits.append(np.packbits(np.bincount((x & (BITS - 1)), minlength=BITS) & 1).view(np.int64))
                    head.append(x[: misses(len(x), percent) * 5 // 4 + 9])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["k1"], batch["k2"], pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sid2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(c, pa.list_(pa.int64())) for c in (head, bits))],
                    names=[x.split()[0] for x in SETS.split(", ")],
                )

    return run


INDEX = "sig long, sid long, cluster long, n long, p long, last long"


def _emit(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in rows], names=[x.split()[0] for x in INDEX.split(", ")])


def _prefixes(percent: int, frequent: np.ndarray):
    """Rows of the index. A set whose head has too few rare tokens gives one row with p = -1 instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for sid, cluster, n, head in zip(*(batch[c].to_pylist() for c in ("sid", "cluster", "n", "head")), strict=True):
                x = np.array(head, np.int64)
                need = misses(n, percent) + 1
                rare = x[~np.isin(x, frequent, assume_unique=True)][:need]
                p, last = len(rare), rare[-1] if len(rare) else 0
                if p < need:
                    rare, p, last = np.zeros(1, np.int64), -1, 0
                for c, v in zip(cols, (rare, *(np.full(len(rare), v) for v in (sid, cluster, n, p, last))), strict=True):
                    c.append(v)
            yield _emit(cols)

    return run


def _long_prefixes(k: int, percent: int, frequent: np.ndarray):
    """The same for sets with few rare tokens, from their texts: rare tokens singly, frequent ones in pairs; p = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, cluster, n, text in zip(*(batch[c].to_pylist() for c in ("sid", "cluster", "n", "text")), strict=True):
                x = shingles(text, k)
                need = misses(n, percent) + 1
                often = np.isin(x, frequent, assume_unique=True)
                rare = x[~often][:need]
                common = x[often][: need - len(rare) + 1] if len(rare) < need else x[:0]
                yield _emit([[c] for c in (rare, *(np.full(len(rare), v) for v in (sid, cluster, n, -1, 0)))])
                for i in range(len(common) - 1):  # a row of pairs at a time
                    with np.errstate(over="ignore"):
                        h = (common[i + 1 :].view(np.uint64) ^ (common[i : i + 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0x94D049BB133111EB)
                    yield _emit([[c] for c in ((h ^ (h >> np.uint64(29))).view(np.int64), *(np.full(len(h), v) for v in (sid, cluster, n, -1, 0)))])

    return run


def _overlaps(k: int):
    """a, b, the sizes of their sets and of the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, kept = None, np.empty(0, np.int64)  # rows come sorted by b
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch[c].to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                if b != old:
                    old, kept = b, shingles(tb, k)
                x = shingles(ta, k)
                out.append((a, b, len(x), len(kept), len(np.intersect1d(x, kept, assume_unique=True))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "na", "nb", "both"])

    return run


def _own_tokens(k: int):
    """Of each member of a cluster the tokens that the representative lacks, those that it lacks itself, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, kept = None, np.empty(0, np.int64)  # rows come sorted by unit
        for batch in batches:
            n, own, lost, far = [], [], [], []
            for unit, text, first in zip(*(batch[c].to_pylist() for c in ("unit", "text", "first")), strict=True):
                if unit != old:
                    old, kept = unit, shingles(first, k)
                x = shingles(text, k)
                n.append(len(x))
                own.append(np.setdiff1d(x, kept, assume_unique=True))
                lost.append(np.setdiff1d(kept, x, assume_unique=True))
                far.append(len(own[-1]) + len(lost[-1]))
            lists = (pa.array(c, pa.list_(pa.int64())) for c in (own, lost))
            yield pa.RecordBatch.from_arrays([batch["sid"], batch["unit"], pa.array(n, pa.int64()), *lists, pa.array(far, pa.int64())], names=["sid", "unit", "n", "own", "lost", "far"])

    return run


def _differences(k: int, percent: int):
    """Of the usual tokens P and Q of two clusters: P - Q, Q - P, and twice what they miss the threshold by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, ta, tb, plus_a, minus_a, plus_b, minus_b in zip(*(batch[c].to_pylist() for c in ("a", "b", "ta", "tb", "plusa", "minusa", "plusb", "minusb")), strict=True):
                x, y = (np.union1d(np.setdiff1d(shingles(t, k), np.array(minus or [], np.int64)), np.array(plus or [], np.int64)) for t, plus, minus in ((ta, plus_a, minus_a), (tb, plus_b, minus_b)))
                p, q = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                out.append((a, b, p, q, 2 * (percent * (len(x) + len(y)) - (100 + percent) * (len(x) - len(p)))))
            if out:
                a, b, p, q, misses_ = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (a, b)), *(pa.array(c, pa.list_(pa.int64())) for c in (p, q)), pa.array(misses_, pa.int64())], names=["a", "b", "p", "q", "misses"])

    return run


class Join:
    """One join: its documents' sets, and the steps over them."""

    def __init__(self, rows: DataFrame, k: int, percent: int) -> None:
        self.k, self.percent = k, percent
        k1, k2 = hash128(F.col("id"), F.col("text"))
        self.texts = rows.select("id", "text").withColumns({"k1": k1, "k2": k2})
        sets, turn = written(self.texts.mapInArrow(_sets(k, percent), SETS), "ngram-sets"), 0
        while True:
            found = sets.filter("n > 0").groupBy("sid").agg(F.min(F.struct("k1", "k2")).alias("one"), F.first("n").alias("n"), F.min("sid2").alias("x"), F.max("sid2").alias("y"))
            found = written(found, "ngram-places")
            # sets are known by the first half of a 128-bit hash; where that is not enough, by a new hash of both halves
            twice = found.filter("x <> y").select("sid", F.lit(True).alias("again"))
            if twice.isEmpty():
                break
            turn += 1
            moved = F.when(F.col("again"), F.xxhash64(F.lit(turn), "sid", "sid2")).otherwise(F.col("sid"))
            sets = written(sets.join(twice, "sid", "left").withColumn("sid", moved).select(*(x.split()[0] for x in SETS.split(", "))), "ngram-sets")
        self.sets, self.places = sets, found.select("sid", "one", "n")

    def text_of(self, sids: DataFrame) -> DataFrame:
        """sid, text and the other columns of sids."""
        wanted = written(self.places.select("sid", "one.*").join(sids, "sid"), "ngram-wanted")
        return self.texts.select("k1", "k2", "text").join(small(wanted), ["k1", "k2"]).drop("k1", "k2")

    def _texts(self, sids: DataFrame) -> DataFrame:
        return written(self.text_of(sids.distinct()).dropDuplicates(["sid"]), "ngram-texts")

    def overlaps(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs a, b of sets with their sizes na, nb and intersection both, and whether they are linked."""
        pairs = written(pairs.select("a", "b"), "ngram-pairs")
        texts = self._texts(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))))
        ta, tb = (texts.select(F.col("sid").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        both = pairs.join(ta, "a").join(tb, "b").sortWithinPartitions("b").select("a", "b", "ta", "tb")
        found = both.mapInArrow(_overlaps(self.k), "a long, b long, na long, nb long, both long")
        return written(found.withColumn("linked", self.linked("na", "nb", F.col("both"))), "ngram-overlaps")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs a, b of sets that are similar."""
        return self.overlaps(pairs).filter("linked").select("a", "b")

    def linked(self, n: str, m: str, both):
        return 100 * both >= self.percent * (F.col(n) + F.col(m) - both)

    def within(self, far, n, m):
        """Sets of these sizes can be similar if they differ in so many tokens."""
        return far * (100 + self.percent) <= (n + m) * (100 - self.percent)

    def fits(self, n1: str, n2: str):
        """Sets of these sizes can be similar."""
        return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * self.percent

    def to_leaders(self) -> DataFrame:
        """Pairs of a set and a leader: of the sets with the same minimum hash, the one whose minimum hashes are the most common."""
        keyed = self.sets.filter("n > 0").select("sid", "n", F.posexplode("keys").alias("i", "key")).distinct()
        common = written(keyed.groupBy("i", "key").agg(F.count("*").alias("sets")).filter("sets > 1"), "ngram-keys")
        shared = written(keyed.join(common, ["i", "key"]), "ngram-shared-keys")
        rank = shared.groupBy("sid").agg(F.round(F.sum(F.log2("sets")), 6).alias("rank"))
        ranked = written(shared.join(rank, "sid").select("i", "key", "sid", "n", "rank"), "ngram-ranked")
        # ties, which a group of copies has many of, fall differently for each hash, so that a group gets several leaders
        best = F.max(F.struct("rank", F.xxhash64("i", "sid"), "sid", "n"))
        leads = written(ranked.groupBy("i", "key").agg(best.alias("lead")).select("i", "key", F.col("lead.sid").alias("b"), F.col("lead.n").alias("m")), "ngram-leaders")
        pairs = ranked.join(leads, ["i", "key"]).filter((F.col("sid") != F.col("b")) & self.fits("n", "m"))
        return pairs.select(F.least("sid", "b").alias("a"), F.greatest("sid", "b").alias("b")).distinct()

    def members(self, near: DataFrame) -> DataFrame:
        """sid, unit (its cluster's representative: the set with the most links), n, own (the tokens that unit lacks), lost (those of unit that it lacks), far (how many both are), for sets in clusters."""
        clusters = connected(near.toDF("u", "v")).toDF("sid", "cluster")
        degree = near.select(F.col("a").alias("sid")).union(near.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("links"))
        ranked = written(clusters.join(degree, "sid"), "ngram-clusters")
        first = written(ranked.groupBy("cluster").agg(F.max(F.struct("links", "sid")).getField("sid").alias("unit")), "ngram-units")
        of = written(ranked.join(first, "cluster").select("sid", "unit"), "ngram-members")
        texts = self._texts(of.select("sid"))
        both = of.join(texts.select("sid", "text"), "sid").join(texts.select(F.col("sid").alias("unit"), F.col("text").alias("first")), "unit")
        return written(both.sortWithinPartitions("unit").mapInArrow(_own_tokens(self.k), "sid long, unit long, n long, own array<long>, lost array<long>, far long"), "ngram-own")

    def candidates(self, members: DataFrame, units: DataFrame) -> DataFrame:
        """Distinct pairs of units (sets outside of clusters, and clusters by their representatives) that the index cannot rule out.

        lo, hi, far: least and largest size of a unit's sets, and the largest distance of one from the representative.
        """
        of = members.select("sid", F.col("unit").alias("cluster"))
        own = self.sets.filter("n > 0").select("sid", "n", "head").join(small(of), "sid", "left").withColumn("cluster", F.coalesce("cluster", "sid"))
        tokens = own.select("sid", "cluster", F.explode("head").alias("sig"))
        held = tokens.groupBy("sig").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y"), F.count_if(F.col("sid") == F.col("cluster")).alias("clusters"))
        shared = written(held.filter("x <> y").select("sig", "clusters"), "ngram-shared")
        often = shared.filter(F.col("clusters") > FREQUENT)
        # the threshold above which at most MOST_FREQUENT tokens lie; so much is sent to the tasks, at any size
        n, least = often.count(), FREQUENT
        if n > MOST_FREQUENT:
            least = int(often.approxQuantile("clusters", [1 - MOST_FREQUENT / 2 / n], 1e-6)[0])
        frequent = np.sort(np.array([x[0] for x in often.filter(F.col("clusters") > least).select("sig").toLocalIterator()], np.int64))
        index = written(own.mapInArrow(_prefixes(self.percent, frequent), INDEX).join(shared.select("sig").withColumn("known", F.lit(True)), "sig", "left").filter("known or p < 0").drop("known").distinct(), "ngram-index")
        rows = index.filter("p > 0")
        heavy = index.filter("p < 0").select("sid", "cluster", "n")
        if not heavy.isEmpty():
            more = self.text_of(heavy).select("sid", "cluster", "n", "text").mapInArrow(_long_prefixes(self.k, self.percent, frequent), INDEX)
            rows = written(rows.unionByName(more.distinct()), "ngram-index")
        # only tokens of more than one cluster can join
        several = rows.groupBy("sig").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).filter("x <> y").select("sig")
        rows = written(rows.join(small(written(several, "ngram-several")), "sig"), "ngram-index")
        sized = rows.join(small(units), F.col("cluster") == F.col("unit"), "left")
        one = sized.filter("unit IS NULL").select("sig", "sid", F.col("n").alias("lo"), F.col("n").alias("hi"), F.lit(0).cast("long").alias("far"), "p", "last")
        many = sized.filter("unit IS NOT NULL").select("sig", F.col("unit").alias("sid"), "lo", "hi", "far", F.lit(-1).cast("long").alias("p"), F.lit(0).cast("long").alias("last")).distinct()
        rows = written(one.unionByName(many), "ngram-index")
        own_bits = self.sets.select("sid", "bits").join(small(written(rows.select("sid").distinct(), "ngram-candidates")), "sid").dropDuplicates(["sid"])
        rows = written(rows.join(own_bits, "sid"), "ngram-index-bits")
        a, b = (rows.select("sig", *(F.col(c).alias(c + x) for c in ("sid", "lo", "hi", "far", "p", "last", "bits"))) for x in "ab")
        differ = sum((F.bit_count(F.get("bitsa", F.lit(i)).bitwiseXOR(F.get("bitsb", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
        close = self.within(differ - F.col("fara") - F.col("farb"), F.col("hia"), F.col("hib"))
        fit = (F.col("hia") * 100 >= F.col("lob") * self.percent) & (F.col("hib") * 100 >= F.col("loa") * self.percent)
        pairs = a.join(b, "sig").filter((F.col("sida") < F.col("sidb")) & fit & close)
        keep = ["loa", "hia", "fara", "lob", "hib", "farb"]
        pairs = pairs.groupBy(F.col("sida").alias("a"), F.col("sidb").alias("b"), *keep, "pa", "pb", "lasta", "lastb").agg(F.count("*").alias("c"))
        # of the prefix that ends first, all tokens of the other set are in the other prefix: what it lacks is known
        overlap = F.ceil(F.lit(self.percent) * (F.col("hia") + F.col("hib")) / (100 + self.percent) - 1e-9)
        lacks = F.when(F.col("lasta") <= F.col("lastb"), F.col("pa") - F.col("c") <= F.col("hia") - overlap).otherwise(F.col("pb") - F.col("c") <= F.col("hib") - overlap)
        return pairs.filter(lacks | (F.col("pa") < 0) | (F.col("pb") < 0)).select("a", "b", *keep).distinct()

    def between(self, unsure: DataFrame, members: DataFrame) -> DataFrame:
        """Links u, v of the units of the pairs a, b whose representatives are not similar, by way of their members (see the top).

        A unit without members is a single set, which is its own member. All sums are doubled, so they are whole.
        """
        t, none = 100 + self.percent, F.array().cast("array<long>")
        involved = written(unsure.select(F.col("a").alias("unit")).union(unsure.select("b")).distinct(), "ngram-involved")
        own = written(involved.join(members.select("unit", "sid", "own", "lost"), "unit", "left").select("unit", F.coalesce("sid", "unit").alias("sid"), F.coalesce("own", none).alias("own"), F.coalesce("lost", none).alias("lost")), "ngram-own")
        # the usual tokens: what more than half of the members have, or lack, unlike the representative
        differ = own.select("unit", F.lit(True).alias("more"), F.explode("own").alias("token")).union(own.select("unit", F.lit(False), F.explode("lost")))
        sizes = own.groupBy("unit").agg(F.count("*").alias("size"))
        most = differ.groupBy("unit", "more", "token").agg(F.count("*").alias("n")).join(sizes, "unit").filter(2 * F.col("n") > F.col("size"))
        usual = written(most.groupBy("unit").agg(F.collect_list(F.when(F.col("more"), F.col("token"))).alias("plus"), F.collect_list(F.when(~F.col("more"), F.col("token"))).alias("minus")), "ngram-usual")
        own = own.join(usual, "unit", "left").withColumns({c: F.coalesce(c, none) for c in ("plus", "minus")})
        own = own.select("unit", "sid", F.array_union(F.array_except("own", "plus"), F.array_except("minus", "lost")).alias("own"), F.array_union(F.array_except("lost", "minus"), F.array_except("plus", "own")).alias("lost"))
        own = written(own.withColumn("h", (-2 * self.percent * F.size("own") - (100 - self.percent) * F.size("lost")).cast("long")).withColumn("top", F.col("h") + t * F.size("lost")), "ngram-own")

        texts = self._texts(involved.select(F.col("unit").alias("sid")))
        of = lambda x: texts.select(F.col("sid").alias(x), F.col("text").alias(f"t{x}")).join(usual.select(F.col("unit").alias(x), F.col("plus").alias(f"plus{x}"), F.col("minus").alias(f"minus{x}")), x, "left")
        both = unsure.select("a", "b").join(of("a"), "a").join(of("b"), "b")
        pairs = written(both.mapInArrow(_differences(self.k, self.percent), "a long, b long, p array<long>, q array<long>, misses long"), "ngram-differences")
        sides = written(pairs.select(F.col("a").alias("unit"), F.col("b").alias("other"), "misses").union(pairs.select("b", "a", "misses")), "ngram-sides")

        # what members gain by own tokens that the other cluster has
        there = pairs.select(F.col("a").alias("unit"), F.col("b").alias("other"), F.col("q").alias("theirs"), F.col("p").alias("ours")).union(pairs.select("b", "a", "p", "q"))
        theirs = there.select("unit", "other", F.explode("theirs").alias("token"))
        tokens = own.select("unit", "sid", F.explode("own").alias("token"))
        gains = tokens.join(theirs, ["unit", "token"]).groupBy("unit", "other", "sid").agg((2 * t * F.count("*")).alias("gain"))
        # own tokens that two clusters have in common
        held = written(own.select("unit", F.explode("own").alias("token")).distinct(), "ngram-held")
        common = held.select(F.col("unit").alias("a"), "token").join(held.select(F.col("unit").alias("b"), "token"), "token").filter("a < b").join(pairs.select("a", "b"), ["a", "b"])
        common = written(common.select(F.col("a").alias("unit"), F.col("b").alias("other"), "token").union(common.select("b", "a", "token")), "ngram-common")
        shared = written(tokens.join(common, ["unit", "token"]), "ngram-own-shared")
        zero = F.lit(0).cast("long")
        active = gains.select("unit", "other", "sid", "gain", zero.alias("xs")).union(shared.select("unit", "other", "sid", zero, F.lit(1).cast("long"))).groupBy("unit", "other", "sid").agg(F.sum("gain").alias("gain"), F.sum("xs").alias("xs"))
        active = written(active.join(own.select("unit", "sid", "top"), ["unit", "sid"]), "ngram-active")

        # members that reach the sum with the best that the other cluster's can give, if all that they lack were a gain
        best = own.groupBy(F.col("unit").alias("other")).agg(F.max("top").alias("plain"))
        found = active.groupBy(F.col("unit").alias("other"), F.col("other").alias("unit")).agg(F.max(F.col("top") + F.col("gain")).alias("gained"))
        sides = written(sides.join(best, "other").join(found, ["unit", "other"], "left").select("unit", "other", "misses", (F.col("misses") - F.greatest("plain", F.coalesce("gained", "plain"))).alias("need")), "ngram-needs")
        keep = ("unit", "other", "sid", "h", "misses", "need", "lost")
        reach = active.join(sides, ["unit", "other"]).filter(F.col("top") + F.col("gain") + 2 * t * F.col("xs") >= F.col("need")).join(own.select("unit", "sid", "h", "lost"), ["unit", "sid"]).select(*keep, "gain", "xs")
        plain = own.join(sides, "unit").filter(F.col("top") >= F.col("need")).join(active.select("unit", "other", "sid"), ["unit", "other", "sid"], "left_anti").select(*keep, zero.alias("gain"), zero.alias("xs"))
        reach = written(reach.union(plain), "ngram-reach")
        # of those, what they lack and the other cluster lacks too
        more = t * F.size(F.array_intersect("lost", "ours"))
        open_ = reach.join(there.select("unit", "other", "ours"), ["unit", "other"]).withColumn("h", F.col("h") + F.col("gain") + more)
        open_ = written(open_.filter(F.col("h") + 2 * t * F.col("xs") >= F.col("need")).select("unit", "other", "sid", "h", "misses"), "ngram-open")
        first = open_.filter("unit < other").select(F.col("unit").alias("u"), F.col("other").alias("v"), F.col("sid").alias("x"), F.col("h").alias("hx"), "misses")
        second = open_.filter("unit > other").select(F.col("other").alias("u"), F.col("unit").alias("v"), F.col("sid").alias("y"), F.col("h").alias("hy"))
        near = first.join(second, ["u", "v"]).filter(F.col("hx") + F.col("hy") >= F.col("misses")).select("u", "v", "x", "y")
        own_shared = shared.join(open_.select("unit", "other", "sid", "h", "misses"), ["unit", "other", "sid"])
        one = own_shared.filter("unit < other").select(F.col("unit").alias("u"), F.col("other").alias("v"), "token", F.col("sid").alias("x"), F.col("h").alias("hx"), "misses")
        two = own_shared.filter("unit > other").select(F.col("other").alias("u"), F.col("unit").alias("v"), "token", F.col("sid").alias("y"), F.col("h").alias("hy"))
        alike = one.join(two, ["u", "v", "token"]).groupBy("u", "v", "x", "y", "hx", "hy", "misses").agg(F.count("*").alias("n")).filter(F.col("hx") + F.col("hy") + 2 * t * F.col("n") >= F.col("misses"))
        chosen = written(near.union(alike.select("u", "v", "x", "y")).select("u", "v", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "ngram-chosen")
        return written(chosen.join(self.links(chosen.select("a", "b").distinct()), ["a", "b"]).select("u", "v").distinct(), "ngram-found")

    def joined(self, members: DataFrame) -> DataFrame:
        """u, root: the units that links join, and what names them together."""
        # the representative itself is a member, at distance 0
        units = written(members.groupBy("unit").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("far").alias("far")), "ngram-units")
        pairs = written(self.candidates(members, units), "ngram-candidates")
        first = self.overlaps(pairs)
        edges = first.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        differ = F.col("na") + F.col("nb") - 2 * F.col("both")
        unsure = pairs.join(first.filter("NOT linked"), ["a", "b"]).withColumn("differ", differ)
        # single sets have no other members; where members are too close to the representatives, none can be similar
        unsure = unsure.join(units.select(F.col("unit").alias("a"), F.lit(True).alias("ma")), "a", "left").join(units.select(F.col("unit").alias("b"), F.lit(True).alias("mb")), "b", "left")
        unsure = unsure.filter("ma OR mb").filter(self.within(F.col("differ") - F.col("fara") - F.col("farb"), F.col("hia"), F.col("hib")))
        # pairs that other links join need no link of their own
        of = connected(edges)
        for c in "ab":
            unsure = unsure.join(of.select(F.col("u").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
        unsure = written(unsure.filter("ra <> rb").select("a", "b"), "ngram-unsure")
        return of if unsure.isEmpty() else connected(edges.union(self.between(unsure, members)))

    def components(self) -> DataFrame:
        """id, k1, k2, n, sid, root, component_id of each row; root names the component, and is null for rows without words."""
        members = self.members(self.links(self.to_leaders()))
        joined = self.joined(members)
        clusters = members.select("sid", F.col("unit").alias("cluster"))
        ids = self.sets.filter("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
        at = ids.join(clusters, "sid", "left").withColumn("u", F.coalesce("cluster", "sid")).join(joined, "u", "left").select("sid", "least", F.coalesce("root", "u").alias("root"))
        at = written(at, "ngram-roots")
        least = written(at.groupBy("root").agg(F.min("least").alias("component_id")), "ngram-least")
        final = written(at.select("sid", "root").join(least, "root").select("sid", "root", "component_id"), "ngram-components")
        mine = self.sets.select("id", "k1", "k2", "n", "sid")
        return mine.join(final, "sid", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))


def connected(edges: DataFrame) -> DataFrame:
    """u, root for each node of the edges (u, v): each round, nodes go over to the neighbour with the least hash of that round.

    With a new hash each round, a constant part of the nodes is expected to go, whatever the shape. Each round is written.
    """
    spark = edges.sparkSession
    edges = written(edges, "edges")
    of = written(edges.select("u").union(edges.select("v")).distinct().select("u", F.col("u").alias("root")), "roots")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.union(edges.select("v", "u"))
        over = both.union(both.select("u", "u")).toDF("u", "v").groupBy("u").agg(F.min(F.struct(F.xxhash64(F.lit(turn), F.col("v")), "v")).getField("v").alias("to"))
        over = written(over, "over")
        moved = edges.join(over, "u").select(F.col("to").alias("x"), F.col("v").alias("u")).join(over, "u").select(F.col("x").alias("u"), F.col("to").alias("v"))
        edges = written(moved.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        to = over.withColumnRenamed("u", "root")
        of = written(of.join(to, "root", "left").select("u", F.coalesce("to", "root").alias("root")), "roots")
    return of if turn else spark.createDataFrame([], "u long, root long")


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n (its shingles), sid (equal sets), root (of the component), component_id, and k1, k2, a hash of id and text.

    Two rows link when 100 * intersection >= percent * union of their sets of k-word shingles; component_id is the smallest
    id reachable by links. Rows without words (null, empty, spaces) link with nothing. Repeated rows are copies of each
    other. A null id is in its component but never its smallest, unless all are null. An empty table gives an empty one.
    Very long texts are compared whole; further columns are left out.
    """
    return Join(packed(docs, id_col, text_col), k, percent).components()


def ngram_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, the one with the least id (null last) and then hash; rows without words all stay.

    Further columns stay as they are, texts of any length whole; see ngram_components().
    """
    found = ngram_components(docs, k, percent, id_col, text_col)
    first = found.filter("n > 0").groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "k1", "k2", "n")).alias("first")).select("first.k1", "first.k2", "first.n")
    stays = first.union(found.filter("n = 0").select("k1", "k2", "n").distinct())
    stays = written(stays, "ngram-stays")
    k1, k2 = hash128(F.col("id"), F.col("text"))
    rows = packed(docs, id_col, text_col).withColumns({"k1": k1, "k2": k2}).join(stays, ["k1", "k2"])
    # repeated rows have one hash: with words, one of them stays
    once = rows.filter("n > 0").dropDuplicates(["k1", "k2"]).unionByName(rows.filter("n = 0"))
    return unpacked(once, docs, id_col, text_col)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d AND r.m < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.m) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.d = w.doc_id GROUP BY ALL
"""
