"""Best-fit packing: documents into sequences of a fixed number of tokens.

Only lengths decide a packing, and there are at most ``capacity`` of them, so the
plan is made from their counts: its cost doesn't grow with the corpus.

1. One pass tokenizes. Where the tokenizer's file names the byte-level split and
   changes nothing before it, its merges also drive a faster library, which takes
   texts of plain letters; any other text or file goes to the tokenizer itself. A row is written for each piece of a document,
   with its rank among the pieces of its length in its task.
2. The driver reads the count of each length (``capacity`` numbers). Pieces above
   a third of the capacity pair at most twice per sequence: greedy matching of
   the largest with the largest that fits, which is optimal for them. The others,
   largest first, go to the smallest gap that holds them, a run of equal gaps at
   a time.
3. Each placement is a range of ranks of one length, so a piece finds its place
   by its rank: offsets of tasks are summed by length, then one binary search.

Defined results: a null text is empty and has the end token alone; rows that
repeat a doc_id are packed each; pieces of one length are alike to the plan and
take their places in the order of tasks and rows; other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.tokens import Encoder, _split_is_known, encoder  # noqa: F401
from siftlake.llm.common import Scratch, map_arrow

def _pieces(path: str, capacity: int, end: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, last = encoder(path), TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        met = [0] * (capacity + 1)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for b in batches:
            rows = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = own.encode(text or "") + last
                n = len(ids) // 4
                start, size = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    rows.append((k, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), task, met[size]))
                    met[size] += 1
                    start, size = start + size, capacity
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names)

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, pieces, first sequence, offset) of ``counts[length]`` pieces."""
    left, used, out, sequences = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0), [], 0
    gaps: list[int] = []  # sorted; runs[g]: sequences with a gap of g, as (first, how many)
    runs: dict[int, list[tuple[int, int]]] = {}

    def put(n: int, many: int, first: int, offset: int) -> None:
        out.append((n, used[n], many, first, offset))
        used[n] += many
        left[n] -= many

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1  # the largest that still fits
        mate = large[at] if at >= 0 else None
        many = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
        if not many:  # one left that could only pair with itself
            mate, many = (large[at - 1], 1) if at > 0 else (None, 1)
        put(n, many, sequences, 0)
        if mate is not None:
            put(mate, many, sequences, n)
        leave(capacity - n - (mate or 0), sequences, many)
        sequences += many
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at < len(gaps):
                gap = gaps[at]
                first, many = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
                take = min(many, left[n])
                put(n, take, first, capacity - gap)
                leave(gap - n, first, take)
                leave(gap, first + take, many - take)
            else:
                each = capacity // n
                for take, deep in ((left[n] // each, each), (1, left[n] % each)):
                    if take and deep:
                        for i in range(deep):
                            put(n, take, sequences, i * n)
                        leave(capacity - deep * n, sequences, take)
                        sequences += take
    return out


def _places(placements: list[tuple[int, int, int, int, int]]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    table = np.array(sorted(placements), np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) + table[:, 1]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
        at = np.searchsorted(key, (n << 48) + rank, side="right") - 1
        out = [b.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.record_batch([*out, pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """A row for each piece of a document: its tokens and its place in a sequence."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")
    pieces = scratch.keep(pieces, "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("c"))
    counts = {r.length: r.c for r in by_task.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    placed = pieces.join(before, ["task", "length"])
    return scratch.result(map_arrow(placed, _places(plan(counts, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
