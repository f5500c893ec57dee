"""MinHash near-dedup: banded universal hash minima, verified links, components.

1. Each text becomes its set of distinct word shingles; ``bands * rows``
   multiply-add hashes of the set keep their minima. Equal sets are one class
   with a number of its own, and only classes go on.
2. Classes that agree on a whole band share a bucket. A pair of similarity 0.8
   misses all of 32 bands of 4 with probability 5e-8.
3. Every member of a bucket is compared with the bucket's lead, never with all
   members. Signatures are compared first: a pair that agrees in under ``floor``
   of the places (five standard deviations below 0.8, 1.4e-6 for a pair at exactly
   0.8) goes. The rest is
   confirmed on the full sets.
4. Alternating large-star and small-star gives components. A bucket whose
   members, without the lead, now lie in one component is finished; the members
   of the others are compared inside tasks, signatures first, skipping pairs that
   are joined already. Large buckets that share members form a group that is cut
   into pieces of ``piece`` shingles; every two pieces meet in one task. So no
   link is lost, no task holds an unbounded group, and only new links leave it.

Defined results: a text without words is linked with nothing, and so is a row
whose doc_id is null (its component_id is null); rows that repeat a doc_id are
one document that holds each of their texts, and so links all that any of them
is linked with (n_shingles is of the row's own text).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch, components, hash_frame, input_bytes, map_arrow, text_bytes

_RNG = np.random.default_rng(20240229)
_WORD_MULTIPLIERS = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, each computed once; emptied when it grows past its bound."""

    LIMIT = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], words: int, known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text."""
    split = [t.lower().split() for t in texts]
    counts = [len(x) for x in split]
    flat = np.fromiter((h for x in split for h in map(known.__getitem__, x)), np.uint64, sum(counts))
    n = len(flat) - words + 1
    joined = np.zeros(max(n, 0), np.uint64)
    for i in range(words):
        joined += flat[i : i + max(n, 0)] * _WORD_MULTIPLIERS[i]
    joined = hash_frame(joined, 0xD6E8FEB86659FD93)
    out, at = [], 0
    for c in counts:
        if c >= words:
            out.append(np.unique(joined[at : at + c - words + 1]))
        elif c:
            short = (flat[at : at + c] * _WORD_MULTIPLIERS[:c]).sum(dtype=np.uint64) + np.uint64(c)
            out.append(hash_frame(np.array([short], np.uint64), 0xA0761D6478BD642F))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


class Minima:
    """Minima of ``bands * rows`` functions (a * x + b) over the high halves of shingle hashes."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(7)
        self.bands, self.rows, m = bands, rows, bands * rows
        self.a = (rng.integers(1, 2**63, m, dtype=np.uint64) | np.uint64(1))[:, None]
        self.b = rng.integers(0, 2**63, m, dtype=np.uint64)[:, None]
        self.salt = rng.integers(1, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)
        self.buffer = np.empty((m, 512), np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x, low = shingles >> np.uint64(32), None
        for i in range(0, len(x), 512):
            part = x[i : i + 512]
            room = self.buffer[:, : len(part)]
            np.multiply(part[None, :], self.a, out=room)
            np.add(room, self.b, out=room)
            least = room.min(axis=1)
            low = least if low is None else np.minimum(low, least)
        return low >> np.uint64(32)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        mixed = (signature.reshape(self.bands, self.rows) * self.salt).sum(axis=1, dtype=np.uint64)
        return hash_frame(mixed + np.arange(self.bands, dtype=np.uint64), 0xE7037ED1A0B428DB).view(np.int64)


def _signatures(words: int, bands: int, rows: int) -> Callable:
    def run(batches):
        known, minima = WordHashes(), Minima(bands, rows)
        for b in batches:
            sets = shingle_sets(text_bytes(b.column(1)), words, known)
            keys, signs, h1, h2 = [], [], [], []
            for s in sets:
                if len(s):
                    sign = minima.signature(s)
                    keys.append(minima.band_keys(sign).tolist())
                    signs.append(sign.astype(np.uint16).tobytes())
                    digest = _digest(s)
                    h1.append(digest[0])
                    h2.append(digest[1])
                else:
                    for x in (keys, signs, h1, h2):
                        x.append(None)
            yield pa.record_batch(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                ["doc_id", "n", "h1", "h2", "bands", "sign"],
            )

    return run


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def _sets(words: int) -> Callable:
    """Sets of classes, each once; a text of another set of the same document is passed over. Takes rows in order of the class."""

    def run(batches):
        known, last = WordHashes(), None
        for b in batches:
            ids, h1, h2 = (b.column(x).to_pylist() for x in ("id", "h1", "h2"))
            keep, sets = [], []
            for i, s in enumerate(shingle_sets(text_bytes(b.column("text")), words, known)):
                if ids[i] != last and _digest(s) == (h1[i], h2[i]):
                    last = ids[i]
                    keep.append(i)
                    sets.append(s.view(np.int64))
            kept = b.select(["id", "n", "sign"]).take(pa.array(keep, pa.int64()))
            yield kept.append_column("shingles", pa.array(sets, pa.list_(pa.int64())))

    return run


def _near(percent: int, floor: float) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Pairs whose sizes and signatures allow the similarity asked for."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, m = (b.column(x).to_numpy() for x in ("n_a", "n_b"))
        ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(len(n), -1) for c in ("sign_a", "sign_b"))
        ok &= (x == y).mean(axis=1) >= floor
        return b.select(["a", "b"]).filter(pa.array(ok))

    return run


def _unit(percent: int, floor: float) -> Callable[[pa.Table], pa.Table]:
    """Links inside one piece of a group, or between two, that join what was apart."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, comp = rows.column("id").to_pylist(), rows.column("comp").to_numpy()
        sets = [x.values.to_numpy() for x in rows.column("shingles").combine_chunks()]
        signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint16).reshape(len(ids), -1)
        side, n = rows.column("side").to_numpy(), np.array([len(x) for x in sets])
        two = len(np.unique(side)) > 1
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        a, b = [], []
        for i in range(1, len(ids)):
            may = (comp[:i] != comp[i]) & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i]))
            if two:
                may &= side[:i] != side[i]
            may = np.flatnonzero(may)
            may = may[(signs[may] == signs[i]).mean(axis=1) >= floor]
            for j in may.tolist():
                if root(comp[i]) == root(comp[j]):
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (n[i] + n[j] - common):
                    a.append(ids[i])
                    b.append(ids[j])
                    parent[root(comp[i])] = root(comp[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, floor: float = 0.62, piece: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    signs = scratch.keep(docs.select("doc_id", "text").mapInArrow(_signatures(words, bands, rows), "doc_id long, n long, h1 long, h2 long, bands array<long>, sign binary"), "signatures")
    linkable = signs.where("n > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("bands", "sign", "n"), "doc_id").alias("x"))
    classes = scratch.keep(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "least", "x.*"), "classes")
    flat = classes.select(F.explode("bands").alias("bucket"), "id")
    shared = flat.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("lead")).where("size > 1")
    members = scratch.keep(flat.join(shared, "bucket").where("id != lead").select("bucket", "id", "lead"), "members")
    wanted = members.select("id").union(members.select("lead")).distinct()
    # a class's set is made again from its least document's text, and dealt into buckets once: no join moves it again
    light = scratch.keep(classes.join(wanted, "id", "left_semi").select("id", "h1", "h2", "least", "n", "sign"), "wanted")
    scratch.free()
    buckets = scratch.buckets(input_bytes(docs))
    texts = docs.select("doc_id", "text").join(light.withColumnRenamed("least", "doc_id").hint("merge"), "doc_id").select("id", "h1", "h2", "n", "sign", "text")
    sets = texts.repartition(buckets, "id").sortWithinPartitions("id").mapInArrow(_sets(words), "id long, n long, sign binary, shingles array<long>")
    sets = scratch.keep_bucketed(sets, "sets", "id", buckets)
    scratch.free()
    # the star round: each member against the lead of its bucket
    side = lambda x, *cols: sets.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    pairs = members.select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    likely = map_arrow(pairs.join(side("a", "n", "sign"), "a").join(side("b", "n", "sign"), "b"), _near(percent, floor), "a long, b long")
    full = likely.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b").withColumn("common", F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long"))
    links = scratch.keep(full.where(F.col("common") * 100 >= (F.size("shingles_a") + F.size("shingles_b") - F.col("common")) * percent).select("a", "b"), "links")
    scratch.free()
    comp = components(scratch, links)
    # the lead has met every member; a bucket whose others lie in one component is finished
    rest = members.select("bucket", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").join(sets.select("id", "n"), "id")
    rest = rest.select("bucket", "id", F.coalesce("component", "id").alias("comp"), F.greatest("n", F.lit(400)).alias("weight"))
    whole = F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("whole")
    open_ = rest.groupBy("bucket").agg(F.count("*").alias("size"), whole, F.sum("weight").alias("total"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("id").alias("first")).where("low != high")
    once = open_.groupBy("size", "whole", "total", "first").agg(F.min("bucket").alias("bucket"))  # buckets of the same members are one
    rest = scratch.keep(rest.join(once.select("bucket", "total", "first"), "bucket"), "rest")
    small = rest.where(F.col("total") <= 2 * piece).select(F.col("bucket").alias("unit"), F.lit(0).alias("p"), F.lit(0).alias("q"), "id", "comp", F.lit(0).alias("side"))
    # large buckets that share members are one group, cut into pieces; every two pieces meet in a task
    large = rest.where(F.col("total") > 2 * piece)
    group = components(scratch, large.select(F.col("id").alias("a"), F.col("first").alias("b")))
    grouped = large.select("id", "comp", "weight").distinct().join(group.withColumnRenamed("node", "id").withColumnRenamed("component", "unit"), "id")
    pieces = grouped.groupBy("unit").agg(F.ceil(F.sum("weight") / piece).cast("int").alias("pieces"))
    cut = grouped.join(pieces, "unit").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
    low = F.least("piece", "other")
    cut = cut.select("unit", low.alias("p"), F.greatest("piece", "other").alias("q"), "id", "comp", (F.col("piece") != low).cast("int").alias("side"))
    units = small.union(cut).join(sets.select("id", "sign", "shingles"), "id")
    more = scratch.keep(units.groupBy("unit", "p", "q").applyInArrow(_unit(percent, floor), "a long, b long"), "more")
    scratch.free()
    # an id that names different sets ties them
    several = linkable.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x != y").select("doc_id")
    tied = linkable.select("doc_id", "h1", "h2").join(several, "doc_id").distinct().join(classes.select("h1", "h2", "id"), ["h1", "h2"]).select("doc_id", "id")
    ties = scratch.keep(tied.join(tied.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").where("id != b").select(F.col("id").alias("a"), "b"), "ties")
    if not more.isEmpty() or not ties.isEmpty():
        comp = components(scratch, links.union(more).union(ties))
    comp = comp.withColumnRenamed("node", "id")
    slim = classes.select("h1", "h2", "id", "least")
    least = slim.join(comp, "id").groupBy("component").agg(F.min("least").alias("name"))
    named = slim.join(comp.join(least, "component"), "id", "left").select("h1", "h2", F.coalesce("name", "least").alias("component_id"))
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    own = signs.where(~alone).join(named, ["h1", "h2"]).select("doc_id", "n", "component_id")
    own = own.union(signs.where(alone).select("doc_id", "n", "doc_id"))
    result = scratch.keep(own.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "result")
    scratch.only(result)
    scratch.free()
    return scratch.result(result)


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose document is the smallest of its component; repeated rows of it stay."""
    found = near_duplicates(docs, words, percent)
    kept = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    out._releases = found._releases
    return out
