"""Matrix products of vectors against vectors of their group, a block against a block at a time.

A large group is dealt by hash into blocks; every two blocks of a group, and each
with itself, meet in a task of their own. A block is some tens of MB at most, so a
task holds no more however large its group is, and a group has ``SPREAD`` blocks
until they are that large: what is shuffled grows as the rows up to there, and
then as their square over the rows of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Block = tuple[pa.Array, np.ndarray | pa.ListArray, np.ndarray]  # keys, ranks and vectors

BLOCK_BYTES = 32 << 20  # of vectors in double precision
SPREAD = 4
TILE = 1024, 2048  # rows of one product: 16 MB at most


def block_pairs(rows: DataFrame, f: Callable[[Block, Block, bool], pa.Table], schema: str, size: int = 4096) -> DataFrame:
    """``f(one, other, same)`` over the blocks of (group, key, rank, v), every two in both orders and each with itself.

    ``rank`` goes with a row as it is; a group of up to ``size`` rows is one block.
    """
    large = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).where(F.col("n") > size)
    many = F.greatest(F.least(F.ceil(F.col("n") / size), F.lit(SPREAD)), F.ceil(F.col("n") * F.col("dim") * 8 / BLOCK_BYTES)).cast("int")
    # a row for each ``size`` rows at most
    cut = rows.join(F.broadcast(large.select("group", many.alias("blocks"))), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("key", "v"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least("block", i).alias("low"), F.greatest("block", i).alias("high")))
    dealt = cut.select("group", F.inline(meets), "block", "key", "rank", "v")

    def side(part: pa.Table) -> Block:
        v = part.column("v").combine_chunks()
        rank = part.column("rank").combine_chunks()
        return part.column("key").combine_chunks(), rank if pa.types.is_list(rank.type) else rank.to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)

    def run(t: pa.Table) -> pa.Table:
        parts = [t.filter(pa.compute.equal(t.column("block"), t.column(i))) for i in ("low", "high")]
        if t.column("low")[0] == t.column("high")[0]:
            block = side(parts[0])
            return f(block, block, True)
        if not all(map(len, parts)):  # a block without rows
            row = side(t.slice(0, 1))
            return f(row, row, True).slice(0, 0)
        low, high = map(side, parts)
        return pa.concat_tables([f(high, low, False), f(low, high, False)])

    return dealt.groupBy("group", "low", "high").applyInArrow(run, schema)


def tiles(n: int, step: int) -> Iterator[slice]:
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def unit(v: np.ndarray) -> np.ndarray:
    """As ``vectors.normalise``, to the last bit."""
    n = np.zeros(len(v))
    for d in range(v.shape[1]):
        n += v[:, d] * v[:, d]
    n = np.sqrt(n)[:, None]
    return np.divide(v, n, out=np.zeros_like(v), where=n != 0)


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of rows i of ``a`` and j of ``b``, summed from first to last as SQL does: a matrix product may round otherwise."""
    out = np.zeros(len(i))
    for at in tiles(len(i), 1 << 16):
        x, y = a[i[at]], b[j[at]]
        for d in range(x.shape[1]):
            out[at] += x[:, d] * y[:, d]
    return out


def above(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether the product of each row of ``a`` with each of ``b`` is above that row's limit; NaN is above any number.

    A matrix product in single precision decides what its rounding can't change; the rest is summed.
    """
    na, nb, dim = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1).max(initial=0), a.shape[1]
    kind = np.float32 if max(na.max(initial=0), nb, np.abs(limit).max(initial=0)) < 1e15 else np.float64
    slack = (4 * dim + 4) * np.finfo(kind).eps * na * nb + 1e-37 * (na + nb + dim)
    s = a.astype(kind) @ b.astype(kind).T
    # limits are rounded by less than the slack's spare part
    sure, maybe = s > (limit + slack).astype(kind)[:, None], s < (limit - slack).astype(kind)[:, None]
    np.logical_or(sure, maybe, out=maybe)
    if not maybe.all():
        i, j = np.nonzero(~maybe)
        exact = products(a, b, i, j)
        sure[i, j] = (exact > limit[i]) | (np.isnan(exact) & ~np.isnan(limit[i]))
    return sure
