"""Embedding near-dedup: epsilon grid order join.

Vectors of one label are near if their cosine is at least ``threshold``, that is
if their unit vectors lie within epsilon = sqrt(2 - 2 * threshold).

1. Equal vectors of a label are one point with a count and a number of its own.
2. The second moments of all points (a matrix of the dimension's size, summed in
   tasks) give principal axes. Cells of width epsilon on the leading axes order
   the points; their number comes last in the order, so a crowded cell can be cut.
3. Each partition of that order is cut into blocks of one label, of at most
   ``block`` bytes, with a box on the leading axes. Blocks meet only if their
   cells on the first axis touch and their boxes lie within epsilon of each other;
   only then does a block travel, once for each partner.
4. A pair of blocks is joined by recursion: sequence intervals that are provably
   distant are skipped, long ones halved, short ones multiplied out. Intervals are
   distant by the leading coordinates and by what is left of the vectors' length
   beside them. A task emits counts, and links that span what they connect.
5. Counts are summed by point; alternating large-star and small-star gives
   components of points, and their least vec_id names them.

Defined results: a vector that is null, zero or holds a null or non-finite
component, and any vector without a label, links with nothing, as do vectors of
different lengths; a null vec_id counts as linked with nothing; rows that repeat
a vec_id are vectors of their own that share it, so an id may stand in several
components, each named by the least id in it. Labels may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import Scratch, components, map_arrow

AXES = 16  # coordinates that are compared, at most
CELLS = 8  # of these, those whose cells make the order
SLACK = 1e-9  # for rounding, in what is skipped
_DTYPE = {"float": np.float32, "double": np.float64}


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _rows(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """Vectors of one length at some places of a column of lists."""
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _leading(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Leading coordinates, and the length of what is left beside them."""
    p = u @ axes
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims).tolist():
            u = _units(_rows(b.column("embedding"), np.flatnonzero(dims == d)))
            sums[d] = sums.get(d, 0) + u.T @ u
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], ["dim", "moments"])


def _merge_moments(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m) for m in rows.column("moments").to_pylist())
    return pa.table({"dim": rows.column("dim")[:1], "moments": pa.array([total.tobytes()], pa.binary())})


def _project(axes: dict[int, np.ndarray], eps: float):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, dims = b.num_rows, b.column("dim").to_numpy()
        cells, vectors = np.zeros((n, CELLS), np.int32), [b""] * n
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = _rows(b.column("embedding"), at)
            p = np.floor((_units(x) @ axes[d])[:, :CELLS] / eps)
            cells[at, : p.shape[1]] = p
            for i, row in zip(at.tolist(), x):
                vectors[i] = row.tobytes()
        names = [*(f"c{i}" for i in range(CELLS)), "vector"]
        out = [pa.array(cells[:, i]) for i in range(CELLS)]
        return pa.record_batch([*(b.column(x) for x in ("label", "dim", "id", "copies")), *out, pa.array(vectors, pa.binary())], ["label", "dim", "id", "copies", *names])

    return run


def _blocks(axes: dict[int, np.ndarray], eps: float, size: int, kind: str):
    """Blocks of the order, with what bounds them on the leading axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        room = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            label, dim = held[0][:2]
            x = np.frombuffer(b"".join(h[4] for h in held), _DTYPE[kind]).reshape(len(held), -1)
            p = _leading(_units(x), axes[dim])
            block, made = (task << 32) + made, made + 1
            low, high = p.min(axis=0), p.max(axis=0)
            f64, i64 = pa.list_(pa.float64()), pa.list_(pa.int64())
            return pa.record_batch(
                [pa.array([block]), pa.array([label], pa.string()), pa.array([dim], pa.int32()), pa.array([low.tolist()], f64), pa.array([high.tolist()], f64), pa.array([int(np.floor(low[0] / eps))], pa.int32()), pa.array([int(np.floor(high[0] / eps))], pa.int32()), pa.array([[h[2] for h in held]], i64), pa.array([[h[3] for h in held]], i64), pa.array([x.tobytes()], pa.binary())],
                ["block", "label", "dim", "low", "high", "first", "last", "ids", "copies", "vectors"],
            )

        for b in batches:
            for row in zip(*(b.column(x).to_pylist() for x in ("label", "dim", "id", "copies", "vector"))):
                if held and (room + len(row[4]) > size or row[:2] != held[0][:2]):
                    yield flush()
                    held, room = [], 0
                held.append(row)
                room += len(row[4])
        if held:
            yield flush()

    return run


class _Pairs:
    """Counts and spanning links of the near pairs of two sequence intervals."""

    def __init__(self, u, p, copies, threshold: float, eps: float, leaf: int):
        self.u, self.p, self.copies = u, p, copies
        self.threshold, self.eps, self.leaf = threshold, eps + SLACK, leaf
        self.count = np.zeros(len(u), np.int64)
        self.parent = list(range(len(u)))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if a0 == a1 or b0 == b1:
            return
        pa_, pb = self.p[a0:a1], self.p[b0:b1]
        gap = np.maximum(0, np.maximum(pa_.min(axis=0) - pb.max(axis=0), pb.min(axis=0) - pa_.max(axis=0)))
        if (gap * gap).sum() > self.eps**2:
            return
        if max(a1 - a0, b1 - b0) > self.leaf:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            self.join(a0, am, b0, bm)
            self.join(am, a1, bm, b1)
            self.join(a0, am, bm, b1)
            if a0 != b0:  # else it is the mirror of the one before
                self.join(am, a1, b0, bm)
            return
        near = self.u[a0:a1] @ self.u[b0:b1].T >= self.threshold
        if a0 == b0:
            near &= np.arange(a1 - a0)[:, None] < np.arange(a1 - a0)[None, :]
        if not near.any():
            return
        self.count[a0:a1] += near @ self.copies[b0:b1]
        self.count[b0:b1] += near.T @ self.copies[a0:a1]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            roots = np.array([self.root(b0 + j) for j in np.flatnonzero(near[i]).tolist()])
            mine = self.root(a0 + i)
            for r in np.unique(roots).tolist():
                if (r := self.root(r)) != (mine := self.root(mine)):
                    self.links.append((a0 + i, r))
                    self.parent[r] = mine


def _join(axes: dict[int, np.ndarray], threshold: float, eps: float, leaf: int, kind: str):
    """Takes the two blocks of a pair one after the other, or the one of a block with itself."""

    def solve(blocks: list[dict]) -> pa.RecordBatch:
        ids = [i for b in blocks for i in b["ids"]]
        u = _units(np.concatenate([np.frombuffer(b["vectors"], _DTYPE[kind]).reshape(len(b["ids"]), -1) for b in blocks]))
        n = len(blocks[0]["ids"])
        pairs = _Pairs(u, _leading(u, axes[blocks[0]["dim"]]), np.array([c for b in blocks for c in b["copies"]], np.int64), threshold, eps, leaf)
        pairs.join(0, n, 0, n) if len(blocks) == 1 else pairs.join(0, n, n, len(ids))
        on = np.flatnonzero(pairs.count)
        a = [ids[i] for i in on.tolist()] + [ids[i] for i, _ in pairs.links]
        z = [None] * len(on) + [ids[j] for _, j in pairs.links]
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(pairs.count[on].tolist() + [0] * len(pairs.links), pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and (row["block_a"], row["block_b"]) != (held[0]["block_a"], held[0]["block_b"]):
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = 4 << 20, leaf: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``."""
    scratch = Scratch(vectors.sparkSession, "grid")
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (F.when(finite, length) > 0), F.lit(False))
    slim = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), ok.alias("ok"))
    key = [F.xxhash64(F.lit(i), "embedding").alias(f"h{i}") for i in (1, 2)]
    good = slim.where("ok").select("vec_id", "label", "embedding", *key)
    # one point for equal vectors; its number is fixed once the table is written
    points = good.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    points = scratch.keep(points.withColumn("dim", F.size("embedding")).withColumn("id", F.monotonically_increasing_id()), "points")
    moments = points.select("dim", "embedding").mapInArrow(_moments, "dim int, moments binary").groupBy("dim").applyInArrow(_merge_moments, "dim int, moments binary").toArrow().to_pydict()
    axes = {}
    for d, m in zip(moments["dim"], moments["moments"]):  # a matrix for each length of vectors
        _, v = np.linalg.eigh(np.frombuffer(m).reshape(d, d))
        axes[d] = np.ascontiguousarray(v[:, ::-1][:, :AXES])
    cells = [f"c{i}" for i in range(CELLS)]
    kinds = "label string, dim int, id long, copies long, " + ", ".join(f"{c} int" for c in cells) + ", vector binary"
    order = ["label", "dim", *cells, "id"]
    ordered = map_arrow(points.select("label", "dim", "id", "copies", "embedding"), _project(axes, eps), kinds).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(_blocks(axes, eps, block, kind), "block long, label string, dim int, low array<double>, high array<double>, first int, last int, ids array<long>, copies array<long>, vectors binary")
    blocks = scratch.keep(blocks, "blocks")
    # blocks meet by the cells of the first axis that they span, each touching the next
    boxes = blocks.select("block", "label", "dim", "low", "high", "first", "last")
    left = boxes.withColumn("cell", F.explode(F.sequence("first", "last"))).select("label", "dim", "cell", F.col("block").alias("block_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    right = boxes.withColumn("cell", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1))).select("label", "dim", "cell", F.col("block").alias("block_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    distance = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    met = left.join(right, ["label", "dim", "cell"]).where((F.col("block_a") <= F.col("block_b")) & (distance <= (eps + SLACK) ** 2))
    pairs = met.select("block_a", "block_b").distinct()
    ends = pairs.withColumn("block", F.explode(F.array_distinct(F.array("block_a", "block_b"))))
    full = ends.join(blocks.select("block", "dim", "ids", "copies", "vectors"), "block").repartition("block_a", "block_b").sortWithinPartitions("block_a", "block_b", "block")
    found = scratch.keep(full.mapInArrow(_join(axes, threshold, eps, leaf, kind), "a long, b long, n long"), "found")
    comp = components(scratch, found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "id")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    slim_points = points.select("label", "h1", "h2", "id", "least", "copies")
    least = slim_points.join(comp, "id").groupBy("component").agg(F.min("least").alias("name"))
    named = slim_points.join(counts, "id", "left").join(comp, "id", "left").join(least, "component", "left")
    named = named.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("name", "least").alias("component"))
    linked = good.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"])
    out = linked.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    out = out.unionByName(slim.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return scratch.result(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
