"""Choosing rows: exact and semantic duplicates, contamination, exact-count samples."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.text import bank_flags, bound_batches, dedup_key, ngram_keys
from siftlake.functions.vectors import dot, normalise
from siftlake.operators.blocks import TILE, Block, above, block_pairs, tiles, unit

BANK_BYTES = 16 << 20


def exact_dup(df: DataFrame, column: str, key: str, name: str = "is_dup") -> DataFrame:
    """Flag every row but the first (by ``key``) of each content; null is never a duplicate.

    The first row of a content is a minimum, pre-aggregated before the shuffle; the
    join back is on key and content, so a content of many rows makes no hot key.
    Null keys come first; rows that share key and content are flagged alike.
    """
    h = dedup_key(F.col(column), dict(df.dtypes)[column])
    firsts = df.select(F.struct(F.col(key)).alias("_first"), h.alias("_g")).where("_g IS NOT NULL").groupBy("_g").agg(F.min("_first").alias("_first"))
    kept = firsts.select(F.col("_first")[key].alias("_key"), "_g", F.lit(True).alias("_kept"))
    out = df.withColumn("_h", h)
    out = out.join(kept, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_g")), "left")
    return out.withColumn(name, F.col("_h").isNotNull() & F.col("_kept").isNull()).drop("_h", "_key", "_g", "_kept")


def contaminated(df: DataFrame, column: str, bank: DataFrame, bank_column: str, key: str, ngram: int = 13, name: str = "contaminated") -> DataFrame:
    """Flag rows that share a lower-cased word n-gram with the bank; null text shares none.

    A bank that its bytes prove small goes to each task, which looks up batches of
    texts. A larger one is shuffled with the texts' grams.
    """
    texts = bank.select(F.col(bank_column).alias("t")).where("t IS NOT NULL")
    if (texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) <= BANK_BYTES:
        held = tuple(sorted({r.t for r in texts.collect()}))  # at most BANK_BYTES
        bound_batches(df.sparkSession)
        flag = F.arrow_udf(lambda x: bank_flags(x, held, ngram), "boolean")
        return df.withColumn(name, F.coalesce(flag(F.col(column)), F.lit(False)))
    grams = bank.select(F.inline(ngram_keys(F.col(bank_column), ngram))).distinct()
    hit = df.select(key, F.inline(ngram_keys(F.col(column), ngram))).join(grams, ["h1", "h2"], "left_semi").select(key).distinct()
    return df.join(hit.withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def semantic_dup(df: DataFrame, column: str, key: str, threshold: float, k: int | None = None, seed: int = 0, name: str = "is_dup", cluster_column: str = "cluster") -> DataFrame:
    """Flag rows with a row nearer the centre of their cluster at a cosine above ``threshold``.

    Clusters come from seeded k-means by cosine with k = max(1, floor(sqrt(n) / 2)).
    A flagged row still counts as earlier for others, so each pair decides alone.
    Zero and null vectors are cluster -1 and never duplicates.
    """
    rows = df.select(F.col(key), F.col(column).alias("_raw"), normalise(F.col(column)).alias("_v")).where(F.col("_v").isNotNull())
    live = rows.where(F.exists("_v", lambda x: x != 0))
    if k is None:
        k = max(1, int(math.sqrt(live.count()) / 2))
    if k == 1:
        means = live.select(F.posexplode("_v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()  # a number for each dimension
        centre = F.array(*[F.lit(float(r.m)) for r in means]) if means else F.array().cast("array<double>")
        put = live.withColumn(cluster_column, F.lit(0)).withColumn("_sim", dot(F.col("_v"), normalise(centre)))
    else:
        model = KMeans(k=k, seed=seed, maxIter=20, initMode="random", distanceMeasure="cosine", featuresCol="_f", predictionCol=cluster_column)
        points = live.withColumn("_f", array_to_vector("_v")).persist()  # k-means reads them in each of its rounds
        fitted = model.fit(points)
        points.unpersist()
        # k centres of the vectors' size: bounded by k, which grows with the root of the rows
        spark = df.sparkSession
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())], f"{cluster_column} int, _c array<double>")
        put = fitted.transform(points).drop("_f").join(centres, cluster_column).withColumn("_sim", dot(F.col("_v"), normalise(F.col("_c"))))
    kind = dict(df.dtypes)[key]

    def dups_of(later: Block, earlier: Block, same: bool) -> pa.Table:
        """Of ``later``, rows with a near row before them; a row that has one asks no further."""
        blocks = [later] if same else [later, earlier]
        order = pa.table({"key": pa.concat_arrays([b[0] for b in blocks]), "sim": np.concatenate([b[1] for b in blocks])})
        order = pa.compute.sort_indices(order, sort_keys=[("sim", "descending"), ("key", "ascending")], null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        mine, theirs = place[: len(later[0])], place[-len(earlier[0]) :]
        at, by = np.argsort(mine), np.argsort(theirs)
        mine, theirs, x, y = mine[at], theirs[by], unit(later[2][at]), unit(earlier[2][by])
        found = np.zeros(len(mine), bool)
        for a in tiles(len(mine), TILE[0]):
            rest = np.arange(a.start, a.stop)
            # from the last row before the tile's to the first: rows alike are near in that order
            for b in reversed(list(tiles(int(np.searchsorted(theirs, mine[a.stop - 1])), TILE[1]))):
                near = above(x[rest], y[b], np.full(len(rest), threshold))
                if theirs[b.stop - 1] >= mine[rest[0]]:
                    near &= theirs[b][None, :] < mine[rest][:, None]
                hit = near.any(axis=1)
                found[rest[hit]] = True
                rest = rest[~hit]
                if not len(rest):
                    break
        return pa.table({key: later[0].take(pa.array(at[found]))})

    # vectors travel as they came and get their length in the task
    rows = put.select(F.col(cluster_column).alias("group"), F.col(key).alias("key"), F.col("_sim").alias("rank"), F.col("_raw").alias("v"))
    dups = block_pairs(rows, dups_of, f"{key} {kind}").distinct().withColumn("_dup", F.lit(True))
    marks = put.select(key, cluster_column).join(dups, key, "left")
    out = df.join(marks, key, "left")
    return out.withColumn(name, F.coalesce("_dup", F.lit(False))).withColumn(cluster_column, F.coalesce(cluster_column, F.lit(-1)).cast("int")).drop("_dup")


def sample(df: DataFrame, key: str, n: int, seed: int = 0, by: str | None = None, name: str | None = None) -> DataFrame:
    """A flag on exactly ``min(n, rows)`` rows in an order given by the seed and the key.

    With ``by``, round-robin over its values (null is one), so small ones give all they have.
    """
    name = name or f"sample_{n}"
    if not name.isidentifier():
        raise ValueError(f"{name!r} is not an identifier")
    if name in df.columns:
        raise ValueError(f"{name} exists")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    keyed = df.select(key, h.alias("_h"), *([by] if by else []))
    if by:
        # only the first n of a stratum can be chosen: a group limit before the shuffle
        w = Window.partitionBy(by).orderBy("_h", key)
        keyed = keyed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
        chosen = keyed.orderBy("_r", "_h", key).limit(n)
    else:
        chosen = keyed.orderBy("_h", key).limit(n)
    return df.join(chosen.select(key, F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
