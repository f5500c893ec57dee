"""Toxicity: a classifier regularised by counterfactuals.

A text's features are its words and their beginnings (four to six characters,
which stand for inflected forms). Those that tell the labels apart are chosen
from a bounded sample of labelled documents, and a logistic model is fitted on
them with a further penalty: each labelled sentence that names a group is
rewritten with other groups in its place, and the squared change of its score is
added to the loss. A group's name can then not carry the decision, so neutral
mentions stay clean. Only features of groups' names (226 at most) change in a
rewritten sentence, so all of them, of whole texts, come down to one matrix of
whole numbers: the sum of the products of their changes.

Fitting takes at most ``sample_docs`` labelled documents outside the held-out
fold and keeps at most ``features``; scoring takes every word of every text.
Defined results: null or empty text has no feature and gets the score of a text
without evidence; rows that repeat a doc_id are scored each (equal texts have
equal scores), and the least of their texts is learnt from with the larger of
their labels; labelled documents are taken in the order of a hash of their id and
features in the order of their evidence, ties by number; without labels of both
kinds the score is their share, or 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import bound_batches
from siftlake.llm.labelled import fold, sample

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

#: Names of groups that stand for one another in a sentence.
GROUPS = [
    ["women", "men", "girls", "boys", "gays", "lesbians", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "foreigners", "africans", "asians", "europeans", "americans", "mexicans", "arabs", "blacks", "whites", "disabled", "elderly", "transgender"],
    ["woman", "man", "girl", "boy", "gay", "lesbian", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "foreigner", "african", "asian", "european", "american", "mexican", "arab", "black", "white", "jewish", "queer", "deaf", "blind"],
    ["frauen", "männer", "muslime", "christen", "juden", "migranten", "ausländer", "schwule", "lesben", "behinderte"],
    ["femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "étrangers", "homosexuels", "lesbiennes", "handicapés"],
    ["mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "extranjeros", "homosexuales", "lesbianas", "gitanos"],
]
_GROUP = {w: g for g in GROUPS for w in g}


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    out = [zlib.crc32(word.encode())]
    out += [zlib.crc32(f"{word[:n]}*".encode()) for n in (4, 5, 6) if len(word) >= n]
    return out


class Features(dict):
    """Chosen features of each word met; emptied when it grows past its bound."""

    LIMIT = 400_000

    def __init__(self, chosen: dict[int, int] | None = None):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= self.LIMIT:
            self.clear()
        got = word_features(word)
        if self.chosen is not None:
            got = [self.chosen[f] for f in got if f in self.chosen]
        self[word] = got
        return got


def text_features(text: str, known: Features) -> set[int]:
    out: set[int] = set()
    for w in set(WORD.findall(text.lower())):
        out.update(known[w])
    return out


def swaps(text: str, known: Features) -> Iterator[tuple[set[int], set[int]]]:
    """Features of each sentence that names a group, and of itself with the next groups of the list."""
    for sentence in SENTENCE.findall(text.lower()):
        words = WORD.findall(sentence)
        if any(w in _GROUP for w in words):
            for shift in (1, 5):
                other = [g[(g.index(w) + shift) % len(g)] if (g := _GROUP.get(w)) else w for w in words]
                a, b = ({f for w in ws for f in known[w]} for ws in (words, other))
                if a != b:
                    yield a, b


def swap_products(texts: Iterable[str], known: Features, named: dict[int, int], block: int = 1024) -> tuple[np.ndarray, int]:
    """Sum of d d' over all swapped sentences of the texts, d being 1 where a feature goes and -1 where one comes; and their number.

    ``named`` gives the features of groups' names their places in d.
    """
    total, n = np.zeros((len(named), len(named)), np.int64), 0
    pairs = chain.from_iterable(swaps(t, known) for t in texts)
    while part := list(islice(pairs, block)):
        d = np.zeros((len(part), len(named)))
        for row, (a, b) in zip(d, part):
            row[[named[f] for f in a - b]] = 1
            row[[named[f] for f in b - a]] = -1
        total += (d.T @ d).astype(np.int64)
        n += len(part)
    return total, n


class Toxicity:
    def __init__(self, chosen: list[int], weights: np.ndarray | None, bias: float):
        self.chosen, self.weights, self.bias = {f: i for i, f in enumerate(chosen)}, weights, bias

    def score(self, texts: list[str | None], known: Features) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.bias)
        logits = np.array([sum(self.weights[i] for i in sorted(text_features(t or "", known))) for t in texts], np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def _train(rows: list[set[int]], named: list[int], products: np.ndarray, pairs: int, y: np.ndarray, n: int, ridge: float, counterfactual: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent with momentum, plus the penalty on swapped sentences."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    on = np.fromiter((i for r in rows for i in sorted(r)), np.int64, len(at))
    w, bias, m1, m2 = np.zeros(n), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        logit = np.bincount(at, w[on], len(rows)) + bias
        wrong = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)
        g = np.bincount(on, wrong[at], n) + ridge * w / len(y)
        if pairs:
            g[named] += 2 * counterfactual / pairs * (products @ w[named])
        g = np.append(g, wrong.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 12_000, features: int = 2048, ridge: float = 0.3, counterfactual: float = 4.0) -> Toxicity:
    spark = docs.sparkSession
    bound_batches(spark)
    rows = sample(docs, labels, "toxic", 4, 2, sample_docs).select("doc_id", "y", "text")
    share = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in share}
    if not n.get(0) or not n.get(1):
        return Toxicity([], None, 1.0 if n.get(1) else 0.0 if n.get(0) else 0.5)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for b in batches:
            met: dict[int, list[int]] = {}
            for y, text in zip(b.column("y").to_pylist(), b.column("text").to_pylist()):
                for f in text_features(text or "", known):
                    met.setdefault(f, [0, 0])[1 if y else 0] += 1
            yield pa.record_batch([pa.array(list(met), pa.int64()), pa.array([v[0] for v in met.values()], pa.int64()), pa.array([v[1] for v in met.values()], pa.int64())], ["f", "clean", "toxic"])

    seen = rows.select("y", "text").mapInArrow(counts, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    sure = ratio / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = seen.where("toxic >= 3").select("f", sure.alias("z")).where("z > 2.5").orderBy(F.desc("z"), "f").limit(features)
    chosen = [r.f for r in best.collect()]  # at most ``features`` numbers
    index = {f: i for i, f in enumerate(chosen)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(index)
        for b in batches:
            on = [sorted(text_features(t or "", known)) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(on, pa.list_(pa.int32()))], ["doc_id", "y", "x"])

    got = rows.mapInArrow(encode, "doc_id long, y int, x array<int>").toArrow().sort_by("doc_id").to_pydict()
    named = {f: i for i, f in enumerate(sorted({index[f] for w in _GROUP for f in word_features(w) if f in index}))}
    products, pairs = np.zeros((len(named), len(named))), 0

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = swap_products((t or "" for b in batches for t in b.column("text").to_pylist()), Features(index), named)
        i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total[i, j], n))], ["i", "j", "n"])

    if named:  # otherwise no swap changes a score
        sums = rows.select("text").mapInArrow(swapped, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
        for i, j, v in sums.collect():  # at most 226 * 226 cells; i of -1 holds the number of swaps
            if i < 0:
                pairs = v
            else:
                products[i, j] = v
    weights, bias = _train([set(x) for x in got["x"]], list(named), products, pairs, np.array(got["y"], np.float64), len(chosen), ridge, counterfactual)
    return Toxicity(chosen, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(model.chosen)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(b.column("text").to_pylist(), known), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
