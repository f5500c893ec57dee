"""Line dedup: levelled sorted runs of line hashes.

Documents arrive in batches of ascending id. A batch hashes its lines, keeps the
smallest document of each hash, merge-anti-joins the runs that earlier batches
left, and writes what is new as a run of its own. When a level holds ``fanout``
runs they are compacted into one run of the next level, so a batch meets
O(log batches) runs. Runs are bucketed and sorted by hash, so only the batch is
shuffled: anti-joins and compactions (an outer join of runs that share no hash,
which interleaves them) merge a run where it lies.

A hash is then owned by one document. A document is given the hashes it owns,
and keeps a line if the line is short or its hash is among them; the join is on
the document's id, so a line that a third of the corpus holds makes no hot key.

Defined results: a null or empty text is one empty line; rows that repeat a
doc_id are one document for ownership and each is rewritten; a null doc_id is a
document that sorts before all others; any other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import NULL_ID, Scratch, fold_columns, input_bytes, map_arrow, unfold_columns

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """128 bits of the stripped line, A-Z lower-cased; None for a short line."""
    line = line.strip(BLANK)
    return xxhash.xxh3_128_digest(line.encode().lower()) if len(line) >= min_chars else None


def _hashes(min_chars: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                own = {line_key(x, min_chars) for x in text.split("\n")}
                own.discard(None)
                ids += [k] * len(own)
                keys += own
        h = np.frombuffer(b"".join(keys), dtype=">i8").astype("i8").reshape(-1, 2)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["k", "h1", "h2"])

    return run


HASH = ["h1", "h2"]


class Runs:
    """The levels of a merge tree of line hashes: (h1, h2, k), each hash in one run only."""

    def __init__(self, scratch: Scratch, fanout: int, buckets: int):
        self.scratch, self.fanout, self.buckets = scratch, fanout, buckets
        self.levels: list[list[DataFrame]] = []

    def add(self, batch: DataFrame) -> None:
        """``batch`` has one row for each hash, dealt into the buckets of the runs: keep those that no run holds."""
        for runs in self.levels:
            for r in runs:
                batch = batch.join(r.select(*HASH).hint("merge"), HASH, "left_anti")
        new, at = self.scratch.keep_bucketed(batch, "run", HASH, self.buckets), 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(new)
            if len(self.levels[at]) < self.fanout:
                return
            full, self.levels[at] = self.levels[at], []
            new, at = full[0], at + 1
            for r in full[1:]:
                both = new.join(r.withColumnRenamed("k", "_k").hint("merge"), HASH, "full_outer").select(*HASH, F.coalesce("k", "_k").alias("k"))
                merged = self.scratch.keep_bucketed(both, "run", HASH, self.buckets)
                self.scratch.drop(new, r)
                new = merged

    def all(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out


def _rewrite(min_chars: int, keep_text: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, owned = batch.column("text").to_pylist(), batch.column("_owned").to_pylist()
        lines, dropped, out = [], [], []
        for text, own in zip(texts, owned):
            parts, own = (text or "").split("\n"), set(own or ())
            kept = [x for x in parts if (h := line_key(x, min_chars)) is None or h in own]
            lines.append(len(parts))
            dropped.append(len(parts) - len(kept))
            out.append("\n".join(kept) if len(kept) < len(parts) or text is not None else None)
        if keep_text:
            return pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("_rest")], ["doc_id", "text", "_rest"])
        digest = [hashlib.sha256((x or "").encode()).hexdigest() for x in out]
        return pa.record_batch([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3, digest: bool = False) -> DataFrame:
    """Drop each line of at least ``min_chars`` code points that a smaller doc_id holds too.

    Returns ``docs`` with its text rewritten, or with ``digest`` the columns
    (doc_id, n_lines, n_dropped, kept_sha256).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    keyed = docs.select(key.alias("k"), "text")
    # bounds may be rough: any cut by id gives the same result
    cuts = sorted(set(docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / batches for i in range(1, batches)], 0.01)))
    hashes = map_arrow(keyed, _hashes(min_chars), "k long, h1 long, h2 long")
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("k").cast("double") > c).cast("int")
    table = scratch.keep(hashes.withColumn("part", part), "hashes", ["part"])
    buckets = scratch.buckets(input_bytes(docs) // (len(cuts) + 1))
    runs = Runs(scratch, fanout, buckets)
    for i in range(len(cuts) + 1):
        # a document's own repeats are gone; a line of many documents is a minimum before it is shuffled
        batch = table.where(F.col("part") == i).groupBy(*HASH).agg(F.min("k").alias("k"))
        runs.add(batch.repartition(buckets, *HASH))
    scratch.drop(table)
    scratch.free()
    both = F.concat(*[F.unhex(F.lpad(F.hex(h), 16, "0")) for h in ("h1", "h2")])
    owned = runs.all().groupBy("k").agg(F.collect_list(both).alias("_owned")).withColumnRenamed("k", "_k")
    folded = fold_columns(docs)
    joined = folded.withColumn("_k", key).join(owned, "_k", "left")
    if digest:
        rows = joined.select("doc_id", "text", "_owned")
        return scratch.result(map_arrow(rows, _rewrite(min_chars, False), "doc_id long, n_lines long, n_dropped long, kept_sha256 string"))
    return scratch.result(unfold_columns(map_arrow(joined.select(*folded.columns, "_owned"), _rewrite(min_chars, True), folded.schema), docs))
