"""Line, exact, near-duplicate and substring deduplication against brute force."""

import collections
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from odd import docs, empty, repeated, texts

from candela.llm import exact_dedup as E
from candela.llm import line_dedup as L
from candela.llm import ngram_join as N
from candela.llm import suffix_dedup as S


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


# ---- lines


def brute_lines(t, least=10, min_docs=2):
    keys = {i: [lower(x).strip(" \t\n\x0b\x0c\r") for x in (x or "").split("\n")] for i, x in t.items()}
    held = collections.defaultdict(set)
    for i, ks in keys.items():
        for k in ks:
            if len(k) >= least:
                held[k].add(i)
    out = {}
    for i, x in t.items():
        lines = (x or "").split("\n")
        gone = [len(held[k]) >= min_docs and min(held[k]) != i for k in keys[i]]
        kept = "\n".join(a for a, g in zip(lines, gone) if not g)
        out[i] = (len(lines), sum(gone), kept)
    return out


def test_lines(spark):
    got = {r.doc_id: r.text for r in L.line_dedup(docs(spark)).collect()}
    want = brute_lines(texts())
    assert got == {i: x[2] for i, x in want.items()} and sum(x[1] for x in want.values()) > 2
    assert L.line_dedup(docs(spark)).columns == docs(spark).columns
    for least in (2, 3, 4):
        want = brute_lines(texts(), min_docs=least)
        found = L.line_drops(docs(spark), min_docs=least).collect()
        assert {r.id: len(r.dropped or ()) for r in found} == {i: x[1] for i, x in want.items()}
    assert 0 < sum(x[1] for x in brute_lines(texts(), min_docs=3).values()) < sum(x[1] for x in brute_lines(texts()).values())


def test_lines_odd(spark):
    assert L.line_dedup(empty(spark)).count() == 0
    rep = L.line_dedup(repeated(spark)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rep}[5] == 2 and {r.doc_id: r["count"] for r in rep}[None] == 2


# ---- exact


def test_exact(spark):
    for budget in (E.TABLE_BYTES, 2000):  # the small one spills again and again
        got = {r.id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.groups(docs(spark), table_bytes=budget).collect()}
        by = collections.defaultdict(list)
        for i, x in texts().items():
            by[lower(x)].append(i)
        want = {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(x.encode()).hexdigest()) for x, ids in by.items() for i in ids}
        assert got == want


def test_exact_keeps_columns_and_one_of_repeated_rows(spark):
    kept = E.exact_dedup(repeated(spark), table_bytes=3000)
    assert kept.columns == docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    # 39 and the null id are empty like 38; 5 is there twice
    assert ids.count(5) == 1 and {34, 39} <= set(ids) and not {38, 1} & set(ids)
    assert {r.doc_id: r.text for r in kept.collect()}[34] == texts()[34]
    assert E.exact_dedup(empty(spark)).count() == 0


def test_an_id_with_different_texts(spark):
    """Rows of one id are one document for lines, and rows of their own for whole texts."""
    t = [(1, "a line of its own\nshared by rows of one id"), (1, "shared by rows of one id"), (2, "a line of its own"), (3, "Other text"), (3, "another text"), (4, "OTHER text")]
    df = spark.createDataFrame(t, "doc_id long, text string").repartition(3)
    lines = sorted((r.doc_id, r.text) for r in L.line_dedup(df).collect())
    assert lines == sorted([t[0], t[1], (2, ""), t[3], t[4], (4, "")])  # the smallest id keeps its lines
    kept = sorted((r.doc_id, r.text) for r in E.exact_dedup(df).collect())
    assert kept == sorted([t[0], t[1], t[2], t[4], t[5]])


def test_equal_digests_compare_contents():
    t = E.Table()
    for i, c in enumerate([b"a", b"b", b"a"]):
        t.add([b"x" * 32, *E.record(c, i, i, 1, b"")[1:]])
    assert sorted(e[2].rows for e in t.entries) == [1, 2]


def test_many_copies_in_one_partition(tmp_path):
    """Linear in copies, and rows of one text go to files; a small budget spills them again."""
    n = 100_000
    start = time.perf_counter()
    for budget in (E.TABLE_BYTES, 4000):
        given = (E.record(b"hot" if i % 5 else b"%d" % (i // 5 % 40), i if i % 7 else None, i, 1, b"%d" % i) for i in range(n))
        found = {g[1]: g for g in E.grace(given, budget, tmp_path / "g")}
        hot = found[b"hot"]
        assert len(found) == 41 and hot[2].file and hot[2].best == (True, n - 1, 1 - n) and hot[3] == b"%d" % (n - 1)
        assert hot[2].rows == n * 4 // 5 == len(list(hot[2])) and {r for _, r in hot[2]} == {i for i in range(n) if i % 5}
    assert time.perf_counter() - start < 20


# ---- near


def brute_components(t, k, percent):
    def shingles(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(x))
        return {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()

    sets = {i: shingles(x) for i, x in t.items()}
    root = {i: i for i in t}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in t if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in t}


def family(seed):
    """Chains of texts that drift apart word by word, with frequent passages in between."""
    r = random.Random(seed)
    passages = [" ".join(f"p{r.randrange(300)}" for _ in range(12)) for _ in range(5)]
    t, i = {}, 0
    for _ in range(6):
        w = " ".join(r.choice(passages) if r.random() < 0.4 else " ".join(f"q{r.randrange(500)}" for _ in range(8)) for _ in range(r.randint(1, 9))).split()
        for _ in range(r.randint(1, 12)):
            t[i] = " ".join(w)
            i += 1
            w = list(w)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
    for x in passages:
        t[i], t[i + 1] = x, x + " " + x
        i += 2
    return t


@pytest.mark.parametrize(("seed", "k", "percent", "frequent"), [(1, 4, 85, 32), (2, 5, 80, 1), (3, 2, 60, 2), (4, 3, 90, 0)])
def test_components(spark, monkeypatch, seed, k, percent, frequent):
    monkeypatch.setattr(N, "FREQUENT", frequent)  # low thresholds send sets by pairs of frequent tokens
    t = {**family(seed), **{1000 + i: x for i, x in texts(seed).items()}}
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n, r.component_id) for r in N.ngram_components(df, k, percent).collect()}
    assert got == brute_components(t, k, percent)


def altered(base, r, n, words_each=1, tag="z"):
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(words_each):
            w[r.randrange(len(w))] = f"{tag}{i}_{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def below_threshold(seed=3, n=24, size=200):
    """Two groups of altered copies of texts whose similarity is just below 0.85, a pair of members that alone links two groups, and groups that share a passage."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(size)]
    other = [*base[: size - 15], *(f"v{i}" for i in range(15))]
    t = altered(base, r, n) + altered(other, r, n, tag="y")
    one, two = [f"a{i}" for i in range(size)], [*(f"a{i}" for i in range(size - 17)), *(f"b{i}" for i in range(17))]
    t += altered(one, r, 6) + altered(two, r, 6, tag="y")
    t += [" ".join([*one[: size - 6], *two[size - 6 :]]), " ".join([*two[: size - 9], *one[size - 9 :]])]
    passage = [f"p{i}" for i in range(60)]
    for g in range(3):
        t += altered([*passage, *(f"g{g}_{i}" for i in range(120))], r, 8, tag=f"x{g}")
    return dict(enumerate(t))


@pytest.mark.parametrize("seed", [3, 4])
def test_clusters_just_below_the_threshold(spark, seed):
    t = below_threshold(seed)
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n, r.component_id) for r in N.ngram_components(df, 4, 85).collect()}
    assert got == brute_components(t, 4, 85)


def test_join_of_clusters_is_linear(spark):
    """Rows that the index join and the members' comparison make, for groups of twice the size: twice as many at most."""
    made = []
    for n in (40, 80):
        t = below_threshold(5, n)
        df = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3)
        join = N.Join(N.packed(df, "doc_id", "text"), 4, 85)
        members = join.members(join.links(join.to_leaders()))
        compared = []
        inner = join.overlaps
        join.overlaps = lambda pairs: compared.append(pairs.count()) or inner(pairs)  # noqa: B023
        join.joined(members)
        made.append(sum(compared))
    assert made[1] <= 2 * made[0] + 20, made


def test_equal_halves_of_identities(spark, monkeypatch):
    monkeypatch.setattr(N, "SIDS", 8)
    t = {**family(6), **texts(6)}
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n, r.component_id) for r in N.ngram_components(df, 4, 85).collect()}
    assert got == brute_components(t, 4, 85)


def test_components_odd(spark):
    assert N.ngram_components(empty(spark)).count() == 0
    kept = N.ngram_dedup(repeated(spark))
    assert kept.columns == docs(spark).columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    want = {c for _, c in brute_components(texts(), 5, 80).values()}
    assert {i for i in ids if i is not None} == want and ids[5] == 1


def test_one_row_of_each_component_stays(spark):
    w = [f"w{i}" for i in range(60)]
    near = [" ".join([*w[:-1], x]) for x in ("a", "b", "c")]
    far = [" ".join(f"{x}{i}" for i in range(30)) for x in "pq"]
    t = [(7, near[0]), (7, near[1]), (9, near[2]), (None, far[0]), (None, far[0] + " end"), (None, far[1]), (None, near[0]), (3, ""), (None, None)]
    df = spark.createDataFrame(t, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in N.ngram_dedup(df).collect()]
    words_ = [x for x in kept if x[1]]
    assert len(words_) == 3 and sum(x in t[:2] for x in words_) == 1 and sum(x in t[3:5] for x in words_) == 1 and t[5] in words_
    assert len(kept) == 5 and t[7] in kept and t[8] in kept


def test_connected(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, r.randrange(1001, 1100)) for _ in range(80)]
    of = {x.u: x.root for x in N.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({of[i] for i in range(301)}) == 1 and len({of[x] for e in edges[300:] for x in e}) == 1 and of[0] != of[1000]


# ---- substrings


def brute_repeats(t, n):
    c = collections.Counter()
    for x in t:
        c.update(hash(x[i : i + n]) for i in range(len(x) - n + 1))
    out = []
    for x in t:
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if c[hash(x[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(a for a, g in zip(x, gone) if not g)
        out.append((len(x), len(x) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("n", "passage", "group"), [(400, 256, S.GROUP), (56, None, S.GROUP), (80, None, 4), (96, 48, 8), (400, None, 4)])
def test_repeats(spark, n, passage, group):
    t = texts(7)
    more = [(5, t[5]), (46, t[8]), (47, t[8][50:] + t[9]), *((50 + i, f"{'ab' * (i % 40)}{i} {t[10][:700]} {i * 7}{t[11][i:90]}") for i in range(20))]
    df = docs(spark, 7, more=more)
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated) for r in S.cut(S.repeats(df, n, passage, group=group)).collect())
    all_texts = [*t.items(), *more]
    data = [(x or "").encode() for _, x in all_texts]
    want = sorted((i, *x, y[1]) for (i, _), x, y in zip(all_texts, brute_repeats(data, n), brute_repeats(data, passage or n)))
    assert got == want


def test_op7_on_a_given_table(spark):
    sf = "/root/testdata/sf0.01"
    t = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_repeated) for r in S.op7_suffix_dedup(spark, sf).collect())
    data = [x for _, x in t]
    assert got == sorted((i, *x, y[1]) for (i, _), x, y in zip(t, brute_repeats(data, 400), brute_repeats(data, 256)))


def test_one_text_in_very_many_rows(spark):
    """A hot context has as many different slices as rows, and no group to sort is larger than GROUP."""
    core = " ".join(f"c{i}" for i in range(110))  # 429 bytes
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string").cast("binary"), 256), F.lit(" " + core + " "), F.md5(F.col("id").cast("string").cast("binary"))).alias("text"))
    got = S.cut(S.repeats(df)).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    n = len(core) + 2
    # a few neighbours' hex digits repeat too
    assert sum(r["count"] for r in got) == 20_000 and all(r.n_spans == 1 and n <= r.n_removed <= n + 16 for r in got)


def test_contexts_that_recur_by_chance(spark, monkeypatch):
    """Texts of few words have many contexts in common and no passage: none of their anchors is written for sorting."""
    r, kept = random.Random(8), {}
    phrases = [f"{x} {y} and so it was said by them" for x in ("one", "two", "three", "four") for y in ("day", "night", "year", "hour")]
    t = [(i, " ".join(r.choice(phrases) + str(r.randrange(10)) for _ in range(40))) for i in range(200)]
    inner = S.written
    monkeypatch.setattr(S, "written", lambda df, label: kept.setdefault(label, inner(df, label)))
    monkeypatch.setattr(S, "discard", lambda *tables: None)
    got = S.cut(S.repeats(spark.createDataFrame(t, "doc_id long, text string"))).filter("n_repeated > 0").count()
    assert got == 0 and kept["suffix-found"].count() == 0


def test_suffix_dedup_odd(spark):
    out = S.suffix_dedup(repeated(spark), 80)
    assert out.columns == docs(spark).columns and out.count() == repeated(spark).count()
    assert S.suffix_dedup(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        S.repeats(docs(spark), 30)


def test_deep_shallow_sorts():
    r = random.Random(3)
    for shallow in (0, 8, 64):
        base = bytes(r.choice(b"ab") for _ in range(200))
        x = [base[: r.randint(0, 200)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 5))) for _ in range(60)]
        order = S.deep_shallow(x, shallow)
        assert [x[i] for i in order] == sorted(x) and sorted(order) == list(range(60))
