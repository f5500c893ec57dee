"""Text signals as column expressions: they stay in the JVM and inside code generation where Spark can."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.vectors import bind

#: The blanks of Python's str.split(), as a Java class.
PY_SPACE = r"(?U)[\s\x1c-\x1f]+"

BATCH_BYTES = 8 << 20  # of an Arrow batch
SLICE_BYTES = 1 << 20  # of the part of it that is in Python's objects


def bound_batches(spark: SparkSession, megabytes: int = BATCH_BYTES >> 20) -> None:
    """Arrow batches are bounded in bytes, so a run of long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def slices(arrays: list[pa.Array], rows: int = 1024, size: int | None = None) -> Iterator[list[pa.Array]]:
    """Parts of at most ``rows`` rows and about ``size`` bytes, one row at least."""
    at, size = 0, size or SLICE_BYTES
    while at < len(arrays[0]):
        n = min(rows, len(arrays[0]) - at)
        part = [a.slice(at, n) for a in arrays]
        while n > 1 and sum(a.nbytes for a in part) > size:
            n = (n + 1) // 2
            part = [a.slice(0, n) for a in part]
        yield part
        at += n


def length(text: Column) -> Column:
    """Words: runs of anything but tab, LF, FF, CR and space."""
    return F.regexp_count(text, F.lit(r"[^\t\n\f\r ]+"))


def n_chars(text: Column) -> Column:
    return F.char_length(text)


def is_val(key: Column, parts: int = 50) -> Column:
    """A fixed hash split: one part of ``parts``."""
    return F.crc32(key.cast("string").cast("binary")) % parts == 0


def hash_part(key: Column, parts: int) -> Column:
    """A split by the first 32 bits of md5, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % parts


def collapsed(text: Column) -> Column:
    """Blanks collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, PY_SPACE, " "))


def dedup_key(column: Column, kind: str) -> Column:
    """md5 of the collapsed text, of raw bytes, or of any other value as text; null for null."""
    if kind == "string":
        return F.md5(collapsed(column).cast("binary"))
    return F.md5(column if kind == "binary" else column.cast("string").cast("binary"))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(collapsed(text)), " "), lambda w: w != "")


def ngrams(text: Column, n: int) -> Column:
    """md5 of each run of ``n`` lower-cased words; a shorter text is one gram, an empty one none."""

    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.md5(F.array_join(F.slice(w, i, n), " ").cast("binary")))
        one = F.array(F.md5(F.array_join(w, " ").cast("binary")))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<string>"))

    return bind(words(text), grams)


def ngram_keys(text: Column, n: int) -> Column:
    """128 bits of each gram of ``ngrams``, as two numbers: cheaper to make and to join than md5."""

    def key(gram: Column) -> Column:
        return F.struct(F.xxhash64(gram).alias("h1"), F.xxhash64(F.lit(1), gram).alias("h2"))

    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: key(F.slice(w, i, n)))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(key(w))).otherwise(F.array().cast("array<struct<h1:long,h2:long>>"))

    return bind(words(text), grams)


class GramBank:
    """Word n-grams of a bank of texts, to look up those of whole batches of other texts.

    A word is hashed once, the hash of a gram is a sum of its words' hashes times
    constants; what the sorted hashes of the bank hold is then compared as words.
    """

    LIMIT = 1 << 17  # words remembered, besides those of one slice

    def __init__(self, bank: list[str], n: int):
        self.n, self.words = n, {}
        rng = np.random.default_rng(13)
        self.by = rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        grams = {tuple(g) for t in bank for g in self._grams((t or "").lower().split())}
        self.long, self.short = {g for g in grams if len(g) == n}, {g for g in grams if len(g) < n}
        flat = self._hash([w for g in self.long for w in g]).reshape(-1, n)
        self.keys = np.unique((flat * self.by).sum(axis=1, dtype=np.uint64))

    def _grams(self, w: list[str]) -> list[list[str]]:
        return [w[i : i + self.n] for i in range(len(w) - self.n + 1)] if len(w) >= self.n else [w] if w else []

    def _hash(self, words: list[str]) -> np.ndarray:
        if len(self.words) > self.LIMIT:
            self.words.clear()
        known, out = self.words, np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out

    def flags(self, texts: list[str | None]) -> list[bool | None]:
        """Whether each text has a gram of the bank; null for null."""
        split = [(t or "").lower().split() for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        out: list[bool | None] = [None if t is None else tuple(w) in self.short for t, w in zip(texts, split)]
        flat = self._hash([x for w in split for x in w])
        m = len(flat) - self.n + 1
        if m > 0 and len(self.keys):
            sums = np.zeros(m, np.uint64)
            for i in range(self.n):
                sums += flat[i : i + m] * self.by[i]
            near = np.minimum(np.searchsorted(self.keys, sums), len(self.keys) - 1)
            ends = np.cumsum(sizes)
            for at in np.flatnonzero(self.keys[near] == sums).tolist():
                i = int(np.searchsorted(ends, at, side="right"))
                first = at - int(ends[i] - sizes[i])
                if not out[i] and first + self.n <= sizes[i] and tuple(split[i][first : first + self.n]) in self.long:
                    out[i] = True
        return out


@functools.lru_cache(maxsize=4)
def gram_bank(bank: tuple[str, ...], n: int) -> GramBank:
    """Made once in a worker."""
    return GramBank(list(bank), n)


def bank_flags(texts: pa.Array, bank: tuple[str, ...], n: int) -> pa.Array:
    held = gram_bank(bank, n)
    return pa.array([x for part in slices([texts]) for x in held.flags(part[0].to_pylist())], pa.bool_())


STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "it", "are", "this", "be"],
    "fr": ["le", "la", "les", "et", "des", "un", "une", "du", "que", "dans", "pour", "sur", "avec", "est"],
    "de": ["der", "die", "das", "und", "ist", "von", "den", "mit", "ein", "eine", "im", "für", "auf", "zu"],
    "es": ["el", "los", "las", "y", "que", "en", "del", "por", "una", "con", "para", "se", "su", "no"],
}


def language(text: Column, min_confidence: float = 0.5) -> Column:
    """A stand-in for a language model: the language with most stop words in the first 2,000 characters, or 'und'."""

    def best(hits: Column) -> Column:
        top, total = F.array_max(hits), F.aggregate(hits, F.lit(0), lambda s, x: s + x)
        code = F.get(F.array(*map(F.lit, STOP_WORDS)), F.array_position(hits, top).cast("int") - 1)
        return F.when((total > 0) & (top / F.greatest(total, F.lit(1)) >= min_confidence), code).otherwise("und")

    def hits(head: Column) -> Column:
        return F.array(*[F.size(F.filter(head, functools.partial(lambda ws, w: w.isin(ws), ws))) for ws in STOP_WORDS.values()])

    found = bind(bind(words(F.substring(collapsed(text), 1, 2000)), hits), best)
    return F.when(text.isNotNull(), found)


def n_tokens(ids: Column) -> Column:
    return F.when(ids.isNotNull(), F.size(ids))


def padded(ids: Column, size: int, pad: int = 0) -> Column:
    """Exactly ``size`` ids: cut or filled."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), size)), 1, size)
