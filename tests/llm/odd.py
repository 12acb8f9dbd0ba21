"""Rows that every operator must take: nulls, empty and long texts, repeated rows, and columns whose names operators use."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, rest string, k1 string, n int, row string, size int, spans int, cluster string, `meta.url` string, `tick``ed` int, `text.raw` string"
WORDS = ["the", "and", "Ünder", "ñandú", "of", "thing", "Sun", "moon"] + [f"w{i}" for i in range(60)]


def words(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts(seed=1):
    """Texts by id: copies that differ in case, near copies, shared lines and passages, odd ones."""
    r = random.Random(seed)
    base = [words(r, r.randint(5, 120)) for _ in range(25)]
    shared = "A line that many documents share.\n" + words(r, 70)
    out = dict(enumerate(base))
    near = base[3].split()
    for i in range(25, 33):  # near copies of one text
        copy = list(near)
        copy[r.randrange(len(copy))] = f"x{i}"
        out[i] = " ".join(copy)
    out |= {33: base[1].upper(), 34: base[1], 35: base[2] + "\n" + shared, 36: shared + "\n" + base[4], 37: "  a LINE that many documents share. \nend", 38: "", 39: None, 40: "  \n\t\n", 41: "one two", 42: "One TWO", 43: "\n\n"}
    out[44] = "lo " * 3000 + words(r, 4000)  # very long, periodic
    out[45] = "é" * 500
    return out


def docs(spark, seed=1, more=()):
    t = list(texts(seed).items()) + list(more)
    rows = [(i, x, "en" if (i or 0) % 3 else None, None if (i or 0) % 11 == 0 else f"s{(i or 0) % 4}", None if x is None else len(x), -7, "r", None, 1, "z", 5, 2, "c", "u", 3, "t") for i, x in t]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def repeated(spark):
    """docs with a row repeated whole, and a row without an id."""
    t = texts()
    return docs(spark, more=[(5, t[5]), (None, "no id here but some words to count and to keep"), (None, None)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
