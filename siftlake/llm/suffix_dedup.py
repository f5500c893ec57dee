"""Suffix-array dedup: drop bytes of passages that already stood earlier.

A byte goes if some ``length``-byte string that covers it starts earlier too (in
a smaller document, or before it in its own). The work is cut so that suffixes
which can agree on ``length`` bytes meet in one task:

1. Texts are dealt into buckets by document once; all lists meet them there.
   Exact copies of a text are owned by the earliest and go whole.
2. Each window of ``length`` bytes is named by the least hash among its grams.
   Neighbouring windows of one name form a region; equal windows have equal
   names, so only names that occur twice can hold repeats. A text has a region
   for about each 39 bytes, and only name and place are shuffled.
3. Equal regions are owned by their earliest occurrence; the others go whole
   (minima by hash, pre-aggregated).
4. Owners of a name that still differ are suffix-sorted: two-stage sorting
   (only suffixes smaller than their successors are sorted directly, the rest is
   induced by bucket scans), then adjacent common prefixes. A task takes whole
   names, about ``chunk`` bytes at a time. A name with more than ``chunk`` bytes
   of different regions is cut first: its windows are named anew by a longer
   string around the least gram that all windows with the gram at about that
   place share, and 3 and 4 are done for these parts. Each such level halves the
   range of places; at the last a name is a whole window, so it always ends.
5. Per document, the spans meet its text once.

A document is told what it owns rather than what it loses, so no join has a hot
key. Defined results: null text is empty; rows that repeat a doc_id are one
document whose different texts lie one after another in the order of their
hashes (equal rows have equal results; no match crosses from text to text); null
doc_ids are documents of their own before all others, in the order of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import NULL_ID, Scratch, fold_columns, hash_frame, input_bytes, map_arrow, text_bytes, unfold_columns

BLOCK = 1 << 18  # bytes hashed at once; a longer text is taken in overlapping parts
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


class Grams:
    """Least gram hash of every window of a block of bytes."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.up, self.down = _powers(_P, BLOCK + length), _powers(_PINV, BLOCK + length)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        n, g = len(data), self.gram
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return hash_frame((sums[g:] - sums[:-g]) * self.down[: n - g + 1], 0xD6E8FEB86659FD93)

    def places(self, body: bytes, name: int) -> np.ndarray:
        """Where the gram ``name`` first stands in each window of a region of that name."""
        n, at, found = len(body) - self.length + 1, 0, []
        while at < n + self.width - 1:
            h = self.hashes(np.frombuffer(body[at : at + BLOCK], np.uint8))
            found.append(at + np.flatnonzero(h.view(np.int64) == name))
            at += BLOCK - self.gram + 1
        found = np.unique(np.concatenate(found))
        return found[np.searchsorted(found, np.arange(n))]

    def parts(self, body: bytes, name: int, level: int) -> list[tuple[int, int, int]]:
        """(first window, windows, name) of the parts of a region whose windows have the gram in one cell of ``2 ** level``."""
        g = self.places(body, name)
        cell = ((g - np.arange(len(g))) << level) // self.width
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (cell[1:] != cell[:-1])]))
        count = np.diff(np.concatenate([first, [len(g)]]))
        out = []
        for a, n, at, c in zip(first.tolist(), count.tolist(), g[first].tolist(), cell[first].tolist()):
            low = -(-c * self.width // (1 << level))  # the places of the gram in this cell
            high = min(self.width - 1, -(-(c + 1) * self.width // (1 << level)) - 1)
            shared = body[at - low : at - high + self.length]
            out.append((a, n, xxhash.xxh3_64_intdigest(shared, level << 8 | c) - (1 << 63)))
        return out

    def regions(self, data: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        """(start, windows, name, whether the name stands twice) of each region; ``bounds`` are the texts."""
        w, h = self.width, self.hashes(data)
        low, have = h, 1
        while have * 2 <= w:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < w:
            low = np.minimum(low[: len(h) - w + 1], low[w - have :])
        ok = np.zeros(len(low) + 1, bool)
        for a, b in bounds:
            ok[a : max(a, b - self.length + 1)] = True
        ok[-1] = False
        first = ok[:-1].copy()
        first[1:] &= (low[1:] != low[:-1]) | ~ok[:-2]
        last = ok[:-1].copy()
        last[:-1] &= (low[1:] != low[:-1]) | ~ok[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last)
        name, count = low[start], end - start + 1
        twice = count > w
        span = np.arange(2 * w)
        for i in range(0, len(start), 4096):
            at = start[i : i + 4096, None] + span[None, :]
            inside = at <= (end[i : i + 4096] + w - 1)[:, None]
            twice[i : i + 4096] |= ((h[np.minimum(at, len(h) - 1)] == name[i : i + 4096, None]) & inside).sum(axis=1) > 1
        return start, count, name.view(np.int64), twice


def _regions(length: int, gram: int) -> Callable:
    """(name, k, start, windows; windows below 0: the name stands twice in the region)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(length, gram)

        def flush(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
            ends = np.cumsum([len(p[2]) for p in parts])
            begins = np.concatenate([[0], ends[:-1]])
            start, count, name, twice = grams.regions(data, list(zip(begins.tolist(), ends.tolist())))
            own = np.searchsorted(ends, start, side="right")
            ks, offsets = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
            return pa.record_batch([pa.array(name), pa.array(ks[own]), pa.array(start - begins[own] + offsets[own]), pa.array(np.where(twice, -count, count).astype(np.int32))], ["f", "k", "start", "n"])

        for b in batches:
            parts, held = [], 0
            for k, base, text in zip(b.column("k").to_pylist(), b.column("base").to_pylist(), text_bytes(b.column("text"))):
                for at in range(0, max(0, len(text) - length + 1), BLOCK - length + 1):
                    part = text[at : at + BLOCK]
                    if held + len(part) > BLOCK:
                        yield flush(parts)
                        parts, held = [], 0
                    parts.append((k, base + at, part))
                    held += len(part)
            if parts:
                yield flush(parts)

    return run


def _listed(b: pa.RecordBatch, column: str, *names: str) -> Iterator[list[np.ndarray]]:
    """The fields of a list of structs, row by row."""
    lists = b.column(column)
    at = lists.offsets.to_numpy()
    fields = [lists.values.field(x).to_numpy(zero_copy_only=False) for x in names]
    for i in range(b.num_rows):
        yield [f[at[i] : at[i + 1]] for f in fields]


def _digests(length: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """128 bits of the bytes of each region of a text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out, rows = [], []
        for k, base, t, (f, start, n) in zip(b.column("k").to_pylist(), b.column("base").to_pylist(), text_bytes(b.column("text")), _listed(b, "hot", "f", "start", "n")):
            mine = (start >= base) & (start < base + len(t))
            a = start[mine] - base
            z = a + np.abs(n[mine]) + (length - 1)
            out += [xxhash.xxh3_128_digest(t[i:j]) for i, j in zip(a.tolist(), z.tolist())]
            rows.append((f[mine], np.full(len(a), k, np.int64), start[mine], n[mine]))
        d = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
        f, k, start, n = (np.concatenate(x) for x in zip(*rows)) if rows else [np.empty(0, np.int64)] * 4
        return pa.record_batch([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(f), pa.array(k), pa.array(start), pa.array(n.astype(np.int32))], ["d1", "d2", "f", "k", "start", "n"])

    return run


def _bodies(length: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """The bytes of the regions that are to be suffix-sorted or cut further."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        f, k, start, body, wide = [], [], [], [], []
        for own, base, text, work in zip(b.column("k").to_pylist(), b.column("base").to_pylist(), text_bytes(b.column("text")), b.column("work").to_pylist()):
            for w in work:
                at = w["start"] - base
                if 0 <= at < len(text):
                    f.append(w["f"])
                    k.append(own)
                    start.append(w["start"])
                    body.append(text[at : at + abs(w["n"]) + length - 1])
                    wide.append(w["wide"])
        return pa.record_batch([pa.array(f, pa.int64()), pa.array(f, pa.int64()), pa.array(k, pa.int64()), pa.array(start, pa.int64()), pa.array(body, pa.binary()), pa.array(wide, pa.bool_())], ["f", "gram", "k", "start", "body", "wide"])

    return run


def _parts(length: int, gram: int, level: int) -> Callable:
    """Wide regions, or parts of them, cut by a longer shared string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(length, gram)
        for b in batches:
            rows = []
            for name, k, start, body in zip(*(b.column(x).to_pylist() for x in ("gram", "k", "start", "body"))):
                for a, n, f in grams.parts(body, name, level):
                    part = body[a : a + n + length - 1]
                    d = np.frombuffer(xxhash.xxh3_128_digest(part), np.int64).tolist()
                    rows.append((*d, f, name, k, start + a, part))
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], ["d1", "d2", "f", "gram", "k", "start", "body"])

    return run


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """Eight bytes from each place as one number; places past the end read as 0."""
    padded = np.concatenate([data[:n], np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= padded[i : i + n] << np.uint64(56 - 8 * i)
    return out


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order of their first ``depth`` bytes by two-stage sorting, and the words at each place.

    A suffix is of type B if it is smaller than its successor, else of type A.
    Type B is sorted directly. In a bucket (one first byte) type A comes first,
    and each suffix of type A follows from its successor, so a scan of the
    buckets in order places them all; a run of one byte is placed in waves.
    """
    n = len(data)
    word = _words(data, n)
    pad = np.concatenate([word, np.zeros(depth + 8, np.uint64)])
    differs = np.empty(n, bool)
    differs[:-1] = data[1:] != data[:-1]
    differs[-1] = True
    nxt = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1] + 1  # the next place with another byte, or the end
    after = np.concatenate([data, [0]])[nxt]
    is_b = (nxt < n) & (after > data)
    order = np.flatnonzero(is_b)
    order = order[np.argsort(word[order], kind="stable")]
    key = word[order]
    tied = np.zeros(len(order), bool)
    same = key[1:] == key[:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.empty(0, np.int64)
    tied[1:] |= same
    tied[:-1] |= same
    for at in range(8, depth, 8):
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key, g = pad[order[where] + at], group[where]
        by = np.lexsort((key, g))
        order[where] = order[where][by]
        key, g = key[by], g[by]
        same = (key[1:] == key[:-1]) & (g[1:] == g[:-1])
        new = np.concatenate([[0], np.cumsum(~same)])
        group[where] = new  # finer than before, and compared only inside ``where``
        still = np.zeros(len(where), bool)
        still[1:] |= same
        still[:-1] |= same
        tied[:] = False
        tied[where[still]] = True
    first_b = np.searchsorted(data[order], np.arange(257), side="left") if len(order) else np.zeros(257, np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[-1]].append(np.array([n - 1]))  # the last suffix is larger than the empty one
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        placed = [wave]
        while len(wave):
            prev = wave - 1
            prev = prev[prev >= 0]
            wave = prev[(data[prev] == c) & ~is_b[prev]]
            placed.append(wave)
        bucket = np.concatenate([*placed, order[first_b[c] : first_b[c + 1]]])
        out.append(bucket)
        prev = bucket - 1
        prev = prev[prev >= 0]
        prev = prev[(data[prev] > c) & ~is_b[prev]]
        if len(prev):
            prev = prev[np.argsort(data[prev], kind="stable")]
            chars, at = np.unique(data[prev], return_index=True)
            for ch, part in zip(chars.tolist(), np.split(prev, at[1:])):
                induced[ch].append(part)
        induced[c] = []
    return np.concatenate(out), pad


def repeated(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Places among ``valid`` whose next ``length`` bytes also stand at a smaller valid place."""
    order, word = suffix_order(data, length)
    order = order[valid[order]]
    if len(order) < 2:
        return np.empty(0, np.int64)
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        where = np.flatnonzero(same)
        same[where] = word[order[where] + at] == word[order[where + 1] + at]
    begins = np.flatnonzero(np.concatenate([[True], ~same]))
    lowest = np.minimum.reduceat(order, begins)
    sizes = np.diff(np.concatenate([begins, [len(order)]]))
    return np.sort(order[order != np.repeat(lowest, sizes)])


def _sorted_suffixes(length: int, chunk: int) -> Callable:
    """(k, a, b): windows a to b of document k stand earlier. Takes rows in order of their name."""

    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:2])
        sizes = np.array([len(r[2]) for r in rows])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        valid = np.ones(len(data), bool)
        for e in (begins + sizes).tolist():
            valid[max(0, e - length + 1) : e] = False
        gone = repeated(data, valid, length)
        own = np.searchsorted(begins, gone, side="right") - 1
        cut = np.flatnonzero((np.diff(gone) > 1) | (np.diff(own) > 0)) if len(gone) else np.empty(0, np.int64)
        a, b = (gone[np.concatenate([[0], cut + 1])], gone[np.concatenate([cut, [len(gone) - 1]])]) if len(gone) else (gone, gone)
        own = np.searchsorted(begins, a, side="right") - 1
        ks, starts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        move = starts[own] - begins[own]
        return pa.record_batch([pa.array(ks[own], pa.int64()), pa.array(a + move), pa.array(b + move)], ["k", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, name = [], 0, None
        for batch in batches:
            for f, k, start, body in zip(*(batch.column(x).to_pylist() for x in ("f", "k", "start", "body"))):
                if f != name and held >= chunk:
                    yield solve(rows)
                    rows, held = [], 0
                name = f
                rows.append((k, start, body))
                held += len(body)
        if rows:
            yield solve(rows)

    return run


def _cut(length: int, gram: int, rewrite: list[str] | None) -> Callable:
    """Remove from each text what its document doesn't own."""

    def lost(grams: Grams, text: bytes, base: int, hot: list[np.ndarray], own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes from and to, in the text."""
        start, n, f = hot
        kind, low, high = own
        span = kind < 0
        a, z = [low[span]], [high[span] + length]
        owned = [dict(zip(low[at].tolist(), (kind[at] & 1).tolist())) for at in (~span & (kind >> 1 == level) for level in range(int(kind.max(initial=0)) // 2 + 1))]

        def visit(at: int, windows: int, name: int, level: int) -> None:
            wide = owned[level].get(at) if level < len(owned) else None
            if wide is None:
                a.append(np.array([at]))
                z.append(np.array([at + windows + length - 1]))
            elif wide:
                body = text[at - base : at - base + windows + length - 1]
                for i, count, _ in grams.parts(body, name, level + 1):
                    visit(at + i, count, name, level + 1)

        mine = (start >= base) & (start < base + len(text))
        for at, windows, name in zip(start[mine].tolist(), np.abs(n[mine]).tolist(), f[mine].tolist()):
            visit(at, windows, name, 0)
        a, z = np.concatenate(a) - base, np.concatenate(z) - base
        inside = (a >= 0) & (a < len(text))
        return a[inside].astype(np.int64), np.minimum(z[inside], len(text)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(length, gram)
        for b in batches:
            n_bytes, removed, spans, out = [], [], [], []
            for text, base, first, hot, own in zip(text_bytes(b.column("text")), b.column("base").to_pylist(), b.column("first").to_pylist(), _listed(b, "hot", "start", "n", "f"), _listed(b, "own", "kind", "a", "b")):
                edge = None
                if not first:
                    if len(text) >= length:
                        edge = np.zeros(len(text) + 1, np.int32)
                        edge[0], edge[-1] = 1, -1
                elif len(hot[0]):
                    edge = np.zeros(len(text) + 1, np.int32)
                    a, z = lost(grams, text, base, hot, own)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, z, -1)
                if edge is None:
                    left, gone = text, np.zeros(0, bool)
                else:
                    gone = np.cumsum(edge[:-1]) > 0
                    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n_bytes.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                out.append(left)
            if rewrite:
                # a character that lost a byte goes with it
                new = pa.array([x.decode("utf-8", "ignore") if r else t for x, r, t in zip(out, removed, b.column("text").to_pylist())], pa.string())
                yield pa.record_batch([new if n == "text" else b.column(n) for n in rewrite], rewrite)
            else:
                digest = [hashlib.sha256(x).hexdigest() for x in out]
                yield pa.record_batch([b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _names(owners: DataFrame, size: Column, chunk: int, again: Column) -> DataFrame:
    """Owners with ``wide``: null if nothing else has the name, else whether the name's bytes pass ``chunk``."""
    by_name = owners.groupBy("f").agg(F.count("*").alias("c"), F.sum(size).alias("bytes"), F.max(again).alias("again")).where("c > 1 OR again")
    return owners.join(by_name.select("f", (F.col("bytes") > chunk).alias("wide")), "f", "left")


def _owned(docs: DataFrame, length: int, gram: int, chunk: int) -> tuple[Scratch, DataFrame, DataFrame]:
    """The texts by document, and what each document owns of its regions."""
    scratch = Scratch(docs.sparkSession, "suffix")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    key = F.coalesce("doc_id", F.lit(NULL_ID) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2))
    keyed = docs.select(key.alias("k"), *docs.columns, F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"), size.alias("size"))
    # different texts of one document lie one after another
    n = scratch.buckets(input_bytes(docs))
    order = Window.partitionBy("k").orderBy("t1", "t2")
    before = F.struct(F.lag("t1").over(order).alias("t1"), F.lag("t2").over(order).alias("t2"))
    laid = keyed.repartition(n, "k").withColumn("again", F.coalesce(before == F.struct("t1", "t2"), F.lit(False)))
    laid = laid.withColumn("base", F.sum(F.when(F.col("again"), 0).otherwise(F.col("size"))).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    texts = scratch.keep_bucketed(laid, "texts", "k", n)
    scratch.free()
    firsts = texts.where("size > 0").groupBy("t1", "t2", "size").agg(F.min(F.struct("k", "base")).alias("x"))
    firsts = firsts.groupBy("x.k").agg(F.collect_set("x.base").alias("firsts"))
    once = texts.where("NOT again AND size >= " + str(length)).select("k", "base", "text")
    texts_ = texts.drop("t1", "t2").join(firsts, "k", "left").withColumn("first", F.coalesce(F.array_contains("firsts", F.col("base")), F.lit(False))).drop("firsts")
    some = texts_.where((F.col("size") >= length) & F.col("first") & ~F.col("again")).select("k", "base", "text")
    regions = scratch.keep(some.mapInArrow(_regions(length, gram), "f long, k long, start long, n int"), "regions")
    names = regions.groupBy("f").agg(F.count("*").alias("c"), F.min("n").alias("n")).where("c > 1 OR n < 0").select("f")
    hot = regions.join(names, "f", "left_semi").repartition(n, "k").groupBy("k").agg(F.collect_list(F.struct("start", "n", "f")).alias("hot"))
    hot = scratch.keep_bucketed(hot, "hot", "k", n)
    scratch.drop(regions)
    scratch.free()
    light = scratch.keep(map_arrow(once.join(hot, "k"), _digests(length), "d1 long, d2 long, f long, k long, start long, n int"), "digests")
    owners = scratch.keep(light.groupBy("d1", "d2").agg(F.min(F.struct("k", "start", "n", "f")).alias("x")).select("x.*"), "owners")
    scratch.drop(light)
    marked = scratch.keep(_names(owners, F.abs("n") + (length - 1), chunk, F.col("n") < 0), "marked")
    scratch.drop(owners)
    scratch.free()
    work = marked.where("wide IS NOT NULL").groupBy("k").agg(F.collect_list(F.struct("f", "start", "n", "wide")).alias("work"))
    bodies = scratch.keep(map_arrow(once.join(work, "k"), _bodies(length), "f long, gram long, k long, start long, body binary, wide boolean"), "bodies")
    kind = lambda level: (F.lit(2 * level) + F.coalesce(F.col("wide").cast("int"), F.lit(0))).alias("kind")
    told, level = marked.select("k", kind(0), F.col("start").alias("a"), F.col("start").alias("b")), 0
    while True:
        narrow = bodies.where("NOT wide").select("f", "k", "start", "body").repartition("f").sortWithinPartitions("f")
        spans = scratch.keep(narrow.mapInArrow(_sorted_suffixes(length, chunk), "k long, a long, b long"), "spans")
        told = told.unionByName(spans.select("k", F.lit(-1).alias("kind"), "a", "b"))
        if bodies.where("wide").isEmpty():
            break
        level += 1
        parts = bodies.where("wide").select("gram", "k", "start", "body").mapInArrow(_parts(length, gram, level), "d1 long, d2 long, f long, gram long, k long, start long, body binary")
        owners = scratch.keep(parts.groupBy("d1", "d2").agg(F.min(F.struct("k", "start", "f", "gram", "body")).alias("x")).select("x.*"), "parts")
        bodies = scratch.keep(_names(owners, F.octet_length("body"), chunk, F.lit(False)), "bodies")
        told = told.unionByName(bodies.select("k", kind(level), F.col("start").alias("a"), F.col("start").alias("b")))
        bodies = bodies.where("wide IS NOT NULL")
    own = scratch.keep_bucketed(told.repartition(n, "k").groupBy("k").agg(F.collect_list(F.struct("kind", "a", "b")).alias("own")), "own", "k", n)
    scratch.only(texts, hot, own)
    scratch.free()
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    met = texts_.join(hot, "k", "left").join(own, "k", "left")
    return scratch, met.select(*docs.columns, "base", "first", empty("hot", "array<struct<start:long,n:int,f:long>>"), empty("own", "array<struct<kind:int,a:long,b:long>>"))


def drop_repeats(docs: DataFrame, length: int = 100, gram: int = 24, chunk: int = 1 << 20, digest: bool = False) -> DataFrame:
    """``docs`` without repeated passages, or (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    if digest:
        scratch, met = _owned(docs.select("doc_id", "text"), length, gram, chunk)
        return scratch.result(met.mapInArrow(_cut(length, gram, None), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    folded = fold_columns(docs)
    scratch, met = _owned(folded, length, gram, chunk)
    return scratch.result(unfold_columns(met.mapInArrow(_cut(length, gram, folded.columns), folded.schema), docs))
