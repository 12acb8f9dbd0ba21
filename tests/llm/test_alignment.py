"""Alignment of two tokenizers against whole texts, token by token."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
from odd import docs, empty, repeated, texts

from candela.llm import alignment as A

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def pair():
    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        return A.Pair(a.read(), b.read())


def brute(pair, items):
    """items: (id, text) -> sorted rows as aligned() returns them."""
    counts, docs = collections.Counter(), []
    for i, text in items:
        both = pair.encode(text) if text else None
        if not both:
            docs.append((i, 0, 0, 0, [], ""))
            continue
        spans = []
        for ids, held in zip(both, (pair.bytes_a, pair.bytes_b), strict=True):
            at, own = 0, []
            for x in ids:
                own.append((x, at, at + len(held[x])))
                at = own[-1][2]
            spans.append(own)
        links, k = [], 0
        for x, s, e in spans[0]:
            while spans[1][k][2] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][1] < e:
                links.append((x, spans[1][j][0]))
                j += 1
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x) for x, s, e in own if start <= s and e <= end) for own in spans))
            start = end
        counts.update(links)
        docs.append((i, *map(len, both), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = [(i, a, b, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for i, a, b, g, ls, sha in docs]
    return sorted(rows, key=str)


#: Spaces of all kinds, special strings, characters that B takes for spaces, bytes that it has no piece for.
ODD = [
    "a  b", " a", "  ", "\n x\n\n  y ", "end ", "tab\t tab\t\tx", "non  breaking  x", "wide　 space", "zero​ width ​ x", "<|endoftext|> <s> </s> <unk> <0x41>", "low▁line", "x ▁", "\U0001f600 \U0001f468‍\U0001f469 ok", "กข 中文 中",
    "don't we'll 'tis", "a\r\n b\r c", "\x1c x\x1d y", "﻿ bom ﻿", "1,234.5 67", "x" * 300 + " " + "y " * 40, "café é", "\x00 nul", "᠎ m᠎ x", "a  b  c", "\x85 nel\x85 x",
]


def got(df):
    return sorted(map(tuple, A.aligned(df, *PATHS).collect()), key=str)


def test_documents(spark, pair):
    t = dict(enumerate(ODD, 200)) | texts()
    r = random.Random(3)
    t |= {300 + i: "".join(r.choice(["a", "The", " ", " ", "\n", "é", " ", "'s", "12", "\t", "-", "Жа", " "]) for _ in range(r.randrange(60))) for i in range(300)}
    assert got(docs(spark, more=[(i, x) for i, x in t.items() if i >= 100])) == brute(pair, t.items())


def test_small_blocks_and_little_memory(spark, pair, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 3000)
    monkeypatch.setattr(A, "SEGMENTS", 50)
    monkeypatch.setattr(A, "SEGMENT_CHARS", 3)
    monkeypatch.setattr(A, "STEP", 500)
    assert got(docs(spark)) == brute(pair, texts().items())


def test_odd(spark, pair):
    assert A.aligned(empty(spark), *PATHS).count() == 0
    t = texts()
    items = [*t.items(), (5, t[5]), (None, "no id here but some words to count and to keep"), (None, None)]
    assert got(repeated(spark)) == brute(pair, items)


def test_dictionary(spark):
    """Groups, links and pairs of the corpus are outputs of their own."""
    al = A.Alignment(docs(spark), *PATHS)
    groups = {r.grp: r.f for r in al.groups.collect()}
    docs_ = al.documents().collect()
    assert sum(groups.values()) == sum(r.n_groups for r in docs_) and len(groups) < sum(groups.values()) / 3
    assert sum(r["count"] for r in al.pairs.collect()) == sum(r.n_links for r in docs_)
    assert {(r.tok_a, r.tok_b) for r in al.links.collect()} == {(r.tok_a, r.tok_b) for r in al.pairs.collect()}


def test_links_of_a_group():
    assert A.links([3], [3]) == [(0, 0)]
    assert A.links([1, 3], [3, 1]) == [(0, 0), (1, 0), (1, 1)]
    assert A.links([5], [1, 2, 2]) == [(0, 0), (0, 1), (0, 2)]
