"""Quality classifier: gated attention over passages (multiple-instance learning).

A text is cut into passages. Each is encoded from its bytes: shares of character
classes, hashed byte pairs, how many of its words are distinct. A hidden layer
embeds the passages, gated attention weighs them, and the weighted mean is
scored. Only documents have labels; the weights of passages are learnt from
them. The model is fitted on the driver, from at most ``sample_docs`` labelled
documents outside the held-out fold and at most ``sample_passages`` passages of
each (chosen evenly); scoring takes every passage of every text.

A passage's features come from its own bytes alone, and products are made row by
row in one order, so a text's score depends on nothing that shares its batch:
equal texts have equal scores in any partitioning.

Defined results: null or empty text is one passage without bytes and is scored
like any other; rows that repeat a doc_id are scored each, and the least of their
texts is learnt from, with the larger of their labels; labelled documents are
taken in the order of a hash of their id, ties by id; without labels of both
kinds the score is their share, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import bound_batches, map_arrow, text_bytes
from siftlake.llm.labelled import fold, sample

PASSAGE = 400  # bytes
_PAIRS = 64


def _classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, blanks, every sign of its own."""
    out = np.zeros(256, np.int64)
    names = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (32, 9), "line": (10, 13), "lead": range(192, 256), "tail": range(128, 192)}
    for i, codes in enumerate(names.values(), 1):
        for c in codes:
            out[c] = i
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    for i, c in enumerate(signs):
        out[c] = len(names) + 1 + i
    return out


_CLASS = _classes()
_N_CLASS = int(_CLASS.max()) + 1
_FEATURES = _N_CLASS + _PAIRS + 4


def encode(texts: list[bytes], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has (at least one)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = int(counts.sum())
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(texts)), sizes)
    where = first[doc] + (np.arange(len(data)) - begins[doc]) // PASSAGE
    out = np.zeros((n, _FEATURES), np.float32)
    length = np.maximum(np.bincount(where, minlength=n), 1)[:, None]
    out[:, :_N_CLASS] = np.bincount(where * _N_CLASS + _CLASS[data], minlength=n * _N_CLASS).reshape(n, -1) / length
    if len(data):
        inside = where[1:] == where[:-1]  # both bytes of a pair lie in one passage
        pair = ((data[:-1].astype(np.uint32) << 8 | data[1:]) * np.uint32(2654435761)) >> np.uint32(26)
        out[:, _N_CLASS : _N_CLASS + _PAIRS] = np.bincount((where[:-1] * _PAIRS + pair)[inside], minlength=n * _PAIRS).reshape(n, -1) / length
        # words, by their first eight bytes, where a word or its rest starts in the passage
        opens = data > 32
        opens[1:] &= ~inside | (data[:-1] <= 32)
        starts = np.flatnonzero(opens)
        words = np.bincount(where[starts], minlength=n)
        padded, of = np.concatenate([data, np.zeros(8, np.uint8)]), np.concatenate([where, np.full(8, -1)])
        key = np.zeros(len(starts), np.uint64)
        open_ = np.ones(len(starts), bool)
        for i in range(8):
            byte = padded[starts + i]
            open_ &= (byte > 32) & (of[starts + i] == where[starts])
            key = key * np.uint64(257) + np.where(open_, byte, 0).astype(np.uint64)
        key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        both = np.unique((where[starts].astype(np.uint64) << np.uint64(40)) | key)
        distinct = np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=n)
        again = starts[1:][(key[1:] == key[:-1]) & (where[starts[1:]] == where[starts[:-1]])]
        out[:, -4] = distinct / np.maximum(words, 1)
        out[:, -3] = np.bincount(where[again], minlength=n) / np.maximum(words, 1)
        out[:, -2] = words / length[:, 0]
    out[:, -1] = np.minimum(length[:, 0] / PASSAGE, 1)
    np.sqrt(out, out=out)
    if most:
        keep = np.concatenate([f + np.unique(np.linspace(0, c - 1, min(c, most)).astype(int)) for f, c in zip(first.tolist(), counts.tolist())])
        return out[keep], np.minimum(counts, most)
    return out, counts


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, each row by the same steps whatever the other rows are: blocks of one shape, no library kernels."""
    n, block = len(x), 256
    room = np.zeros((-(-n // block) * block, x.shape[1]))
    room[:n] = x
    return np.concatenate([np.einsum("ij,jk->ik", room[i : i + block], w) for i in range(0, len(room), block)])[:n] if n else np.empty((0, w.shape[1]))


class GatedAttention:
    """Embeds passages, weighs them by gated attention and scores their weighted mean."""

    def __init__(self, features: int, hidden: int = 24, gate: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float64)
        self.p = {"W": init(features, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate, 1)[:, 0], "c": init(hidden, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(features), np.ones(features), None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
        p, first = self.p, np.concatenate([[0], np.cumsum(counts)[:-1]])
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        logit = z @ p["c"] + p["d"][0]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40))), {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "first": first, "counts": counts}

    def gradient(self, y: np.ndarray, score: np.ndarray, m: dict) -> dict:
        p, n = self.p, len(y)
        dl = (score - y) / n
        g = {"c": m["z"].T @ dl, "d": np.array([dl.sum()])}
        dz = np.repeat(dl[:, None] * p["c"], m["counts"], axis=0)
        dh = m["a"][:, None] * dz
        da = (dz * m["h"]).sum(axis=1)
        de = m["a"] * (da - np.repeat(np.add.reduceat(m["a"] * da, m["first"]), m["counts"]))
        ts = m["t"] * m["s"]
        g["w"] = ts.T @ de
        dts = de[:, None] * p["w"]
        dt, ds = dts * m["s"] * (1 - m["t"] ** 2), dts * m["t"] * m["s"] * (1 - m["s"])
        g["V"], g["U"] = m["h"].T @ dt, m["h"].T @ ds
        dh += dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - m["h"] ** 2)
        g["W"], g["b"] = m["x"].T @ dx, dx.sum(axis=0)
        return g

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> GatedAttention:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        first, rng, step = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.random.default_rng(seed), 0
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        epochs = max(epochs, -(-1500 * 32 // len(y)))  # a small sample is seen more often
        for _ in range(min(epochs, 120)):
            order = rng.permutation(len(y))
            for i in range(0, len(y), 32):
                own = order[i : i + 32]
                rows = np.concatenate([np.arange(first[j], first[j] + counts[j]) for j in own])
                score, memory = self.forward(x[rows], counts[own])
                step += 1
                for k, g in self.gradient(y[own], score, memory).items():
                    g = g + decay * self.p[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def weigh(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden vectors and attention (before its softmax) of all passages, and how many each text has."""
        p = self.p
        x, counts = encode(texts)
        h = np.tanh(_product((x - self.mean) / self.scale, p["W"]) + p["b"])
        gated = np.tanh(_product(h, p["V"])) / (1 + np.exp(-_product(h, p["U"])))
        return h, _product(gated, p["w"][:, None])[:, 0], counts

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of texts, a megabyte of passages at a time; a longer text is added up part by part."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        p, size = self.p, (1 << 20) // PASSAGE * PASSAGE
        out = np.empty(len(texts))

        def close(i: int, z: np.ndarray, total: float) -> None:
            logit = float((z / total * p["c"]).sum() + p["d"][0])
            out[i] = 1 / (1 + np.exp(-min(max(logit, -40.0), 40.0)))

        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and held + len(texts[end]) <= size:
                held += len(texts[end])
                end += 1
            if end > at:
                h, e, counts = self.weigh(texts[at:end])
                ends = np.cumsum(counts)
                for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist()), at):
                    weight = np.exp(e[a:b] - e[a:b].max())
                    close(i, (weight[:, None] * h[a:b]).sum(axis=0), weight.sum())
            else:
                top, total, z, text = -np.inf, 0.0, np.zeros(len(p["c"])), texts[at]
                for i in range(0, len(text), size):
                    h, e, _ = self.weigh([text[i : i + size]])
                    new = max(top, e.max())
                    weight, old = np.exp(e - new), np.exp(top - new)
                    total, z, top = total * old + weight.sum(), z * old + (weight[:, None] * h).sum(axis=0), new
                close(at, z, total)
                end = at + 1
            at = end
        return out


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000, sample_passages: int = 32) -> GatedAttention:
    """The model, from the bounded sample."""
    bound_batches(docs.sparkSession)

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        x, counts = encode(text_bytes(b.column("text")), sample_passages)
        cut = np.split(x, np.cumsum(counts)[:-1])
        return pa.record_batch([b.column("doc_id"), b.column("y"), pa.array([c.tobytes() for c in cut], pa.binary())], ["doc_id", "y", "x"])

    rows = map_arrow(sample(docs, labels, "quality", 5, 0, sample_docs).select("doc_id", "y", "text"), features, "doc_id long, y int, x binary").toArrow().sort_by("doc_id").to_pydict()
    x = [np.frombuffer(v, np.float32).reshape(-1, _FEATURES) for v in rows["x"]]
    y = np.array(rows["y"], np.float64)
    counts = np.array([len(v) for v in x], np.int64)
    return GatedAttention(_FEATURES).fit(np.concatenate(x) if x else np.empty((0, _FEATURES), np.float32), counts, y)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, **bounds)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column("doc_id"), pa.array(model.score(text_bytes(b.column("text"))), pa.float64())], ["doc_id", "score"])

    scored = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject."""
    model = fit(docs, labels, **bounds)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(model.score(text_bytes(b.column("text"))) >= threshold))

    return map_arrow(docs, run, docs.schema)
