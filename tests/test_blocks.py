"""Vectors against vectors in blocks: nothing leaves a task but counts and flags, and no task takes a whole group."""

import functools

import numpy as np
from pyspark.sql import functions as F

from siftlake.functions import vectors
from siftlake.operators import blocks, measure, select
from siftlake.plans import queries


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _write(spark, at, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def test_recall_blocks(spark, tmp_path, monkeypatch):
    """Repeated vectors, keys and labels, nulls, vectors of two lengths: as a join of all pairs counts them."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 20]], i % 3) for i in range(90)]
    rows += [(5, [float(x) for x in base[7]], 2), (7, [float(x) for x in base[2]], 0), (200, None, 1), (None, [float(x) for x in base[3]], 1), (201, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (202, [1.0, 2.0], 2), (203, [float("nan")] * 6, 0), (204, [9.0] * 6, None)]
    sf = _write(spark, tmp_path, rows)
    monkeypatch.setattr(measure, "block_pairs", functools.partial(blocks.block_pairs, size=4))
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    a = e.select("label", F.col("vec_id").alias("q"), F.col("embedding").alias("_a"))
    b = e.select("label", F.col("vec_id").alias("i"), F.reverse("embedding").alias("_b"))
    want = measure.recall_at(a.join(b, "label").select("q", "i", vectors.dot(F.col("_a"), F.col("_b")).alias("s")), "q", "i", "s").first()
    found = queries.recall_at_k(spark, sf)
    assert tuple(found.first()) == (round(want.r1, 4), round(want.r5, 4)) and 0 < want.r5 < 100
    assert "label" not in "".join(x for x in _plan(found).splitlines() if "Join" in x)  # no row for a pair


def test_above():
    """Equal products are equal, however the matrix product rounds; NaN is above numbers."""
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 64))
    b = np.concatenate([a, a, np.full((1, 64), np.nan)])
    own = blocks.products(a, a, np.arange(30), np.arange(30))
    got = blocks.above(a, b, own)
    assert got[:, -1].all() and not got[np.arange(30), np.arange(30)].any() and not got[np.arange(30), 30 + np.arange(30)].any()
    assert own.tolist() == [functools.reduce(lambda s, x: s + x * x, map(float, v), 0.0) for v in a]


def test_semantic_blocks(spark, monkeypatch):
    """Flags by all pairs, equal vectors and sims too; ranks are not numbered in one task."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 5))
    v = np.concatenate([base, base[:20], rng.standard_normal((300, 5)), np.tile(base[3], (15, 1))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(select, "block_pairs", functools.partial(blocks.block_pairs, size=9))
    monkeypatch.setattr(select, "TILE", (7, 5))
    out = select.semantic_dup(df, "v", "id", 0.93, k=1)
    assert "Window" not in _plan(out)
    got = {r.id: r.is_dup for r in out.collect()}
    # sims by the operator's own expressions, so that ties are ties
    c = [r.m for r in df.select(F.posexplode(vectors.normalise(F.col("v"))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]
    sim = {r.id: r.s for r in df.select("id", vectors.dot(vectors.normalise(F.col("v")), vectors.normalise(F.array(*map(F.lit, c)))).alias("s")).collect()}
    order = sorted(range(len(v)), key=lambda i: (-sim[i], i))
    near = u @ u.T > 0.93
    want = {i: bool(near[i, order[:n]].any()) for n, i in enumerate(order)}
    assert got == want and 0 < sum(want.values()) < len(want)
