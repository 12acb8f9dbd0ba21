"""Toxicity by weak supervision.

Voters are lexicon entries (words, and stems that match the start of words) and patterns of writing, each of which fires on a
text or does not. A generative label model explains the votes alone: a text belongs to one of a few latent classes (clean
writing, and kinds of toxic writing, such as the languages), in which each voter has its own rate of firing, given whether the
voter with which it is most correlated within classes fires. Expectation maximisation estimates rates and correlations without
a given truth; the annotators are one more voter, whose rates are estimated like all others, and their rows select the
lexicon and name each class toxic or clean. A linear classifier over the counts of the
same entries is then trained on the posterior labels and scores every text.
The lexicon is mined from the labelled training rows, so it follows the corpus and its languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import packed, small, table, unpacked, with_rest, written

#: About so many labelled rows at most are used for fitting, chosen by a hash of their ids; the lexicon is counted on all.
SAMPLE = 20_000
#: Entries of the lexicon, and training rows that must hold one.
ENTRIES, SUPPORT = 768, 4
#: Latent classes of the label model, and the part of an entry's labelled rows that must be toxic if it is to vote in it.
CLASSES, PURE = 12, 0.8
#: What a toxic row weighs in the classifier, of which there are few: a missed one costs more than a clean one that is marked.
WEIGHT = 4.0
STEMS = (3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
SHOUTING, EXCLAIMING, CURSING = re.compile(r"\b[A-Z]{3,}\b.*\b[A-Z]{3,}\b", re.S), re.compile(r"!{2,}|\?!|!\?"), re.compile(r"[@#$%&*!]{4,}")
MASKED, REPEATING = re.compile(r"\b[^\W\d_]+[*@$#][^\W\d_*@$#]+"), re.compile(r"(\w)\1{3,}")
ADDRESS = frozenset("you your tu vous du ihr vosotros usted".split())
#: Patterns of writing, as functions of a text and its words; what is cheap to see comes first.
PATTERNS = {
    "shouting": lambda text, words: bool(SHOUTING.search(text)),
    "exclaiming": lambda text, words: "!" in text and bool(EXCLAIMING.search(text)),
    "cursing": lambda text, words: bool(CURSING.search(text)),
    "masked": lambda text, words: any(c in text for c in "*@$#") and bool(MASKED.search(text)),
    "addressing": lambda text, words: not ADDRESS.isdisjoint(words),
    "repeating": lambda text, words: bool(REPEATING.search(text)),
}
FOLDS = 5


def held_out(id_col: str = "id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def entries(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many clean and toxic texts hold each entry, in parts."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    known: dict[str, list[str]] = {}
    for batch in batches:
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            for word in words.difference(known):
                known[word] = entries(word)
            found[y].update(set().union(*map(known.__getitem__, words)))
        if len(found[0]) + len(found[1]) > 500_000:
            yield _counts(found)
            found = (Counter(), Counter())
        if len(known) > 500_000:
            known.clear()
    if found[0] or found[1]:
        yield _counts(found)


def _counts(found: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(found[0] | found[1])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([x[e] for e in names], pa.int64()) for x in found)], names=["entry", "clean", "toxic"])


def lexicon(rows: DataFrame, entries_most: int = ENTRIES, support: int = SUPPORT) -> list[str]:
    """The entries that tell toxic from clean best, by the information that they give about the label; at most entries_most."""
    n = {x["y"]: x["n"] for x in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = F.lit(float(n.get(0, 0))), F.lit(float(n.get(1, 0)))
    sums = rows.select("text", "y").mapInArrow(_mine, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    held = sums.filter(F.col("clean") + F.col("toxic") >= support)
    both, every = F.col("clean") + F.col("toxic"), clean + toxic
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    gain = (
        part(F.col("toxic"), both * toxic / every) + part(F.col("clean"), both * clean / every)
        + part(toxic - F.col("toxic"), (every - both) * toxic / every) + part(clean - F.col("clean"), (every - both) * clean / every)
    )
    best = held.withColumn("gain", gain).filter(F.col("gain") > 4).orderBy(F.desc("gain"), "entry").limit(entries_most)
    return [x["entry"] for x in best.select("entry").collect()]


def _votes(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = Spots(names)
        for batch in batches:
            where, counts, marks, words = [], [], [], []
            for text in batch["text"].to_pylist():
                i, n, own = spots(text)
                where.append(i)
                counts.append(n)
                words.append(own.total())
                marks.append([p(text or "", own) for p in PATTERNS.values()])
            yield pa.RecordBatch.from_arrays(
                [batch["y"], pa.array(where, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.bool_())), pa.array(words, pa.int64())],
                names=["y", "at", "n", "marks", "words"],
            )

    return run


class Spots:
    """Places of the lexicon's entries that a text holds, how often it does, and its words. Words once seen are remembered."""

    def __init__(self, names: list[str]) -> None:
        self.at = {e: i for i, e in enumerate(names)}
        self.seen: set[str] = set()
        self.places: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> tuple[list[int], list[int], Counter]:
        words = Counter(WORD.findall((text or "").lower()))
        if len(self.seen) > 500_000:
            self.seen.clear()
            self.places.clear()
        for word in set(words).difference(self.seen):
            self.seen.add(word)
            if places := [self.at[e] for e in entries(word) if e in self.at]:
                self.places[word] = places
        found: dict[int, int] = {}
        for word in words.keys() & self.places.keys():
            n = words[word]
            for i in self.places[word]:
                found[i] = found.get(i, 0) + n
        return list(found), list(found.values()), words


# ---- the label model and the classifier, on the votes of a bounded sample


def _blocks(n: int, size: int = 4096) -> Iterator[slice]:
    return (slice(i, min(i + size, n)) for i in range(0, n, size))


def _start(votes: np.ndarray, classes: int, seed: int) -> np.ndarray:
    """First class weights: rows without votes are class 0; the others go by likeness to rows that are unlike each other."""
    n = len(votes)
    fires = votes.sum(axis=1, dtype=np.float32)
    fired = np.flatnonzero(fires)
    q = np.full((n, classes), 1e-3)
    q[fires == 0, 0] = 1
    if not len(fired):
        return q / q.sum(axis=1, keepdims=True)

    def likeness(i: int) -> np.ndarray:
        both = np.concatenate([votes[fired[b]].astype(np.float32) @ votes[i] for b in _blocks(len(fired))])
        return both / np.maximum(fires[fired] + fires[i] - both, 1)

    seeds = [fired[np.random.default_rng(seed).integers(len(fired))]]
    near = [likeness(seeds[0])]
    for _ in range(classes - 2):
        best = np.max(near, axis=0)
        far = np.flatnonzero(best <= np.quantile(best, 0.2))
        seeds.append(fired[far[fires[fired[far]].argmax()]])
        near.append(likeness(seeds[-1]))
    q[fired, 1:] = (np.stack(near, axis=1) + 1e-3) ** 2
    return q / q.sum(axis=1, keepdims=True)


def correlations(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each two voters, the correlation that is left within the classes; variances are a row's more, so that classes which explain a voter leave none."""
    total = q.sum(axis=0)
    both = sum((v.T @ v for v in (votes[b].astype(np.float32) for b in _blocks(len(votes)))), np.float32(0)).astype(np.float64) / len(votes)
    mean = sum(q[b].T @ votes[b] for b in _blocks(len(votes))) / np.maximum(total, 1e-9)[:, None]
    left = both - (mean * (total / len(votes))[:, None]).T @ mean
    scale = np.sqrt(np.maximum(np.diag(left), 0) + 1 / len(votes))
    out = left / np.outer(scale, scale)
    np.fill_diagonal(out, 0)
    return out


def parents(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each voter the one that it depends on (-1: none): the maximum spanning forest of the squared correlations that pay for their parameters."""
    weight = correlations(votes, q) ** 2
    weight[weight * len(votes) <= q.shape[1] * np.log(len(votes))] = 0
    m = len(weight)
    parent, best, reach = np.full(m, -1), np.zeros(m), np.full(m, -1)
    todo = np.ones(m, bool)
    for _ in range(m):
        i = int(np.where(todo, best, -1).argmax())
        todo[i], parent[i] = False, reach[i]
        more = todo & (weight[i] > best)
        best[more], reach[more] = weight[i][more], i
    return parent


def label_model(votes: np.ndarray, classes: int = CLASSES, rounds: int = 24, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """votes: rows by voters, 0 or 1. Posterior of the classes for each row, each voter's rate of firing by class, and parents()."""
    n, m = votes.shape
    q, parent = _start(votes, classes, seed), np.full(m, -1)
    overall = votes.mean(axis=0)
    for turn in range(rounds):
        if turn in (4, 10):
            parent = parents(votes, q)
        on = lambda b: np.where(parent >= 0, votes[b][:, parent], 0).astype(np.float32)  # noqa: B023, E731
        total, one, up, both = q.sum(axis=0)[:, None], 0, 0, 0
        for b in _blocks(n):
            v, p = votes[b].astype(np.float32), on(b)
            one, up, both = one + q[b].T @ v, up + q[b].T @ p, both + q[b].T @ (v * p)
        # rates where the parent fires and where it does not, smoothed by one row that fires like all rows do
        given = np.where(up.sum(axis=0) > 0, both.sum(axis=0) / np.maximum(up.sum(axis=0), 1e-9), overall)
        rest = (one.sum(axis=0) - both.sum(axis=0)) / np.maximum(n - up.sum(axis=0), 1e-9)
        high, low = (np.clip(x, 1e-5, 1 - 1e-5) for x in ((both + given) / (up + 1), (one - both + rest) / (total - up + 1)))
        prior = np.log(np.clip(total[:, 0] / n, 1e-9, 1))
        # log likelihood: that of nothing firing, and what each vote, each parent's vote and both together add
        silent, vote, parent_votes = np.log1p(-low), np.log(low) - np.log1p(-low), np.log1p(-high) - np.log1p(-low)
        together = np.log(high) - np.log1p(-high) - vote
        for b in _blocks(n):
            v, p = votes[b].astype(np.float32), on(b)
            z = v @ vote.T + p @ parent_votes.T + (v * p) @ together.T + silent.sum(axis=1) + prior
            z = np.exp(z - z.max(axis=1, keepdims=True))
            q[b] = z / z.sum(axis=1, keepdims=True)
    rates = sum(q[b].T @ votes[b] for b in _blocks(n)) / np.maximum(q.sum(axis=0), 1e-9)[:, None]
    return q, rates, parent


def posterior(votes: np.ndarray, y: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Posterior of label 1 for each row: the weight of the classes whose rows the labels y mostly mark. That is their only use here."""
    q, _, _ = label_model(votes, classes)
    toxic = q.T @ y >= 0.5 * q.sum(axis=0)
    return q[:, toxic].sum(axis=1)


def linear(x: np.ndarray, p: np.ndarray, decay: float = 2e-4, steps: int = 400, weight: float = WEIGHT) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, whose toxic part counts `weight` times, by Adam on the whole sample."""
    counts = 1 + (weight - 1) * p
    counts = (counts / counts.mean()).astype(np.float32)
    mean = float((p * counts).mean())
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(max(mean, 1e-3) / max(1 - mean, 1e-3)))
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    p = p.astype(np.float32)
    for t in range(1, steps + 1):
        e = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - p) * counts
        g, gb = x.T @ e / len(p) + decay * w, float(e.mean())
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.05 / (1 + 3 * t / steps)
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8)
    return w, b


def _voters(fires: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The votes of the entries (the first n columns) that fire on toxic rows mostly, of all patterns, and of the annotators."""
    pure = fires[y == 1].sum(axis=0) >= PURE * np.maximum(fires.sum(axis=0), 1)
    pure[n:] = True
    return np.concatenate([fires[:, pure], y[:, None] == 1], axis=1).astype(np.uint8)


def _matrix(votes: pa.Table, n: int) -> np.ndarray:
    """Log counts of the n entries, the patterns' votes, and the text's length."""
    x = np.zeros((votes.num_rows, n + len(PATTERNS) + 1), np.float32)
    at, counts, marks = (votes[c].combine_chunks() for c in ("at", "n", "marks"))
    row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
    x[row, at.flatten().to_numpy()] = np.log1p(counts.flatten().to_numpy())
    x[:, n:-1] = marks.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(PATTERNS))
    x[:, -1] = np.log1p(votes["words"].to_numpy()) / 10
    return x


VOTES = "y int, at array<int>, n array<int>, marks array<boolean>, words long"


def _fit(n: int):
    """Weights and bias from the votes of the whole sample, which one task holds; nothing where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [b for b in batches if b.num_rows]
        if sample:
            votes = pa.Table.from_batches(sample)
            x, y = _matrix(votes, n), votes["y"].to_numpy()
            w, b = linear(x, posterior(_voters(x[:, :-1] > 0, y, n), y))
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([b], pa.float64())], names=["weights", "bias"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The model: names of its entries, weights, bias. labels: id_col and toxic, of which rows outside the held-out fold are used.

    Labels other than 0 and 1 and those without an id are left out; of several for an id the largest counts; rows that repeat
    are fitted as often. Null texts are empty ones. Without labelled rows, as with an empty table, the model knows no entries
    and scores all texts low. Whole texts are counted, very long ones too; further columns are not looked at.
    """
    y = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y")).filter(~held_out())
    y = written(y, "toxic-labels")
    n = y.count()
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20))
    chosen = y if n <= sample else y.filter(part < int(sample / n * (1 << 20)))
    texts = packed(docs, id_col, text_col).select("id", "text")
    names = lexicon(texts.join(small(y), "id"))
    rows = written(texts.join(F.broadcast(chosen), "id"), "toxic-sample")
    votes = written(rows.select("text", "y").mapInArrow(_votes(names), VOTES), "toxic-votes")
    # the sample is bounded, so that a task can hold it; the driver gets weights only
    fitted = votes.coalesce(1).mapInArrow(_fit(len(names)), "weights array<double>, bias double").collect()
    if not fitted:
        return {"names": [], "weights": [0.0] * (len(PATTERNS) + 1), "bias": -4.0}
    return {"names": names, "weights": list(fitted[0].weights), "bias": fitted[0].bias}


def _scores(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n = np.array(model["weights"], np.float64), len(model["names"])
        spots = Spots(model["names"])
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                where, counts, words = spots(text)
                z = model["bias"] + w[-1] * math.log1p(words.total()) / 10 + sum(w[n + i] for i, p in enumerate(PATTERNS.values()) if p(text or "", words))
                if where:
                    z += float(w[where] @ np.log1p(counts))
                out.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["rest"], batch["text"], pa.array(out, pa.float64())], names=["id", "rest", "text", "score"])

    return run


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs in the form of packed() with score, from 0 to 1; null is an empty text.

    Each row gives a row, repeated rows too; an empty table gives none. Very long texts are scored whole; further columns are in `rest`.
    """
    rows = packed(docs, id_col, text_col)
    return rows.mapInArrow(_scores(model), with_rest(rows, "text string, score double"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more (see train() and scored()), with all their columns; an empty table gives an empty one."""
    found = scored(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return unpacked(found.filter(F.col("score") < threshold), docs, id_col, text_col)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
