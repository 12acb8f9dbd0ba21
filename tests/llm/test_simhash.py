"""Fingerprints and their links against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from odd import docs, empty, repeated, texts

from candela.llm import simhash as S


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def brute_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, reach=3):
    """Of each fingerprint the least number of one that links reach."""
    p = list(range(len(fps)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    v = np.array(fps, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= reach):
            a, b = find(i), find(i + 1 + int(j))
            p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def brute(t, k=3, reach=3):
    ids = sorted(t)
    fps = [brute_fingerprint(t[i], k) for i in ids]
    return {i: (f, ids[r]) for i, f, r in zip(ids, fps, roots(fps, reach), strict=True)}


def got(df, **more):
    return {r.id: (r.fp % 2**64, r.component_id) for r in S.simhash_components(df, **more).collect()}


def test_components(spark):
    t = texts()
    t |= {100 + i: f"{t[7]} {i}" for i in range(8)} | {120 + i: t[9] + " end" * i for i in range(5)}
    more = [(i, x) for i, x in t.items() if i >= 100]
    want = brute(t)
    assert got(docs(spark, more=more), k=3) == want
    assert len({c for _, c in want.values()}) < len(want) - 10 and want[38] == (0, 38) and want[40][1] == 38
    assert got(docs(spark, more=more), k=5, reach=9) == brute(t, 5, 9)


def test_odd(spark):
    assert S.simhash_components(empty(spark)).count() == 0
    found = S.simhash_components(repeated(spark), k=3).collect()
    assert len(found) == len(texts()) + 3 and sum(r.id == 5 for r in found) == 2
    assert {r.component_id for r in found if r.fp == 0} == {38}  # a row without an id is never the smallest
    assert [r.component_id for r in found if r.id is None and r.fp != 0] == [None]


def points(kind, n, seed):
    r = np.random.default_rng(seed)
    if kind == "random":
        return np.unique(r.integers(0, 2**63, n).astype(np.uint64))
    if kind == "cube":  # half of the bits vary
        return np.unique(sum((r.random(n) < 0.5).astype(np.uint64) << np.uint64(2 * b) for b in range(24)))
    out = np.repeat(r.integers(0, 2**63, 10).astype(np.uint64), n // 10)
    for _ in range(6):
        out = out ^ np.where(r.random(len(out)) < 0.6, np.uint64(1) << r.integers(0, 64, len(out)).astype(np.uint64), np.uint64(0))
    return np.unique(out)


def joined(fps, edges):
    at = {x: i for i, x in enumerate(fps.tolist())}
    p = list(range(len(at)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for u, v in edges:
        a, b = find(at[u % 2**64]), find(at[v % 2**64])
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(p))]


@pytest.mark.parametrize("kind", ["random", "cluster", "cube"])
def test_trees_find_every_link(kind):
    for n in (5, 400, 3000):
        fps = points(kind, n, n)
        edges = [e for h in (0, 1) for u, v in S.in_shard(fps, [S.halves(3)[h], (S.WHOLE, 3)], 3) for e in zip(u.tolist(), v.tolist(), strict=True)]
        assert joined(fps, edges) == roots(fps.tolist())
        assert len(edges) <= 30 * len(fps)  # a forest for each leaf, not pairs


def test_what_no_tree_parts():
    fps = np.unique(np.array([(1 << a) | (1 << b) | (1 << c) for a in range(30) for b in range(a) for c in range(b)], np.uint64))
    u, v = S.in_leaf(fps, 3)
    assert len(fps) > 4 * S.LEAF and joined(fps, zip(u.tolist(), v.tolist(), strict=True)) == roots(fps.tolist()) and len(u) < len(fps)


def test_shards_dealt_again(spark, monkeypatch):
    """Small limits: several rounds of trees over shards, the same components."""
    for name, x in (("SAMPLE", 200), ("SHARD", 20), ("LIMIT", 60), ("LEAF", 8)):
        monkeypatch.setattr(S, name, x)
    fps = points("cluster", 1500, 5)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = [(r.u, r.v) for r in S.near_pairs(df).collect()]
    assert joined(fps, edges) == roots(fps.tolist())


def test_a_text_of_many_words():
    r = random.Random(1)
    text = " ".join(f"w{r.randrange(900)}" for _ in range(70_000))
    assert S.fingerprint(S.shingle_hashes(text, 3)) == brute_fingerprint(text, 3)
