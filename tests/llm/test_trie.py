"""The prefix trie against a trie walked in Python."""

import hashlib
import math
import random
import zlib

from candela.llm import prefix_trie as T

SCHEMA = "conv_id long, turn int, role string, text string, conv string, pos int, node long, `meta.url` string"


def brute(rows):
    """rows: (conv_id, turn, role, text). The nodes as op11's contract defines them."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]  # as SQL: -3 % 5 = -3
    return nodes(made)


def nodes(made):
    members, ends = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for n, ms in members.items():
        below = [x for x in members if x[: len(n)] == n]
        kids = [x for x in members if len(x) == len(n) + 1 and x[:-1] == n]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in below)
        text = ",".join(map(str, sorted(ends.get(n, []))))
        out.append((min(ms), len(n), min(members[n[:-1]]) if n else None, len(ms), len(kids), leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, "u") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, T.prefix_trie(*T.rebuilt(T.ordered_turns(df))).collect()), key=str)


def rows_of(seed):
    """Conversations with common beginnings, one that is very long, gaps in the ids, ties, nulls and repeated rows."""
    r = random.Random(seed)
    rows = []
    for c in range(40):
        if c % 7 == 3:
            continue
        for t in range(r.choice([1, 2, 3, 5, 8, 9, 16, 17, 30])):
            rows.append((c, t, r.choice(["user", "assistant"]) if t > 3 else "user", f"é{r.randrange(2)}" if t < 12 else f"w{r.randrange(50)} " * 3))
    rows += [(45, t, "user", "same") for t in range(33)]
    rows += [(50, None, None, None), (50, 0, "", ""), (50, 0, "user", "b"), (50, 0, "user", "a"), (51, 1, "user", "x" * 50_000), (51, 1, "user", "x" * 50_000)]
    return rows + [(52, t, "user", f"é{t % 2}") for t in range(12) for _ in range(2)] + [(-3, 1, "user", "negative")]


def test_trie(spark):
    rows = rows_of(1)
    assert run(spark, [*rows, (None, 1, "user", "no conversation")]) == brute(rows)


def test_no_turns(spark):
    assert run(spark, []) == []
    # crc32("7") % 9 = 2, so of one turn none is left, and there is no conversation 5
    assert run(spark, [(7, 1, "user", "x")]) == brute([(7, 1, "user", "x")]) == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_plain_conversations(spark):
    """The operator alone, without rebuilding."""
    made = {1: ["a", "b", "c"], 2: ["a", "b"], 3: ["a", "b", "d"], 4: [], 9: ["a", "b"]}
    turns = [(c, i, x.encode(), 1) for c, xs in made.items() for i, x in enumerate(xs)]
    got = T.prefix_trie(spark.createDataFrame(turns, "conv long, pos long, key binary, n_bytes long"), spark.createDataFrame([(c,) for c in made], "conv long"))
    assert sorted(map(tuple, got.collect()), key=str) == nodes({c: [("", x) for x in xs] for c, xs in made.items()})


def test_many_members_in_pieces(spark, monkeypatch):
    """Pieces and slices of a few rows give what large ones give."""
    monkeypatch.setattr(T, "IDS", 3)
    monkeypatch.setattr(T, "SLICE", 4)
    rows = [(c, t, "user", "same") for c in range(100, 160) for t in range(9 + c % 3)]
    assert run(spark, rows) == brute(rows)


def test_dense_names(spark):
    df = spark.createDataFrame([(i, i % 17) for i in range(200)], "i long, key long").repartition(5)
    found, after = T.named(df, ["key"], "name", "test", first=4)
    got = {(r.i % 17, r.name) for r in found.select("i", "name").collect()}
    assert after == 21 and sorted(n for _, n in got) == list(range(4, 21)) and found.count() == 200
