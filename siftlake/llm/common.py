"""What the operators share: the scratch folder, Arrow batches and graph components.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
every executor of a cluster can read; they cut lineage, so that a lost executor
costs the tasks it ran and no more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.text import bound_batches

NULL_ID = -(2**63)  # stands for a null id inside the operators, and so sorts first
BUCKET_BYTES = 128 << 20  # about what a task takes of a bucketed table


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one only where the session names none and runs on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")
        at = "file://" + tempfile.mkdtemp(prefix="siftlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Tables in a folder of the shared one.

    They go one by one as soon as nothing reads them. What a result still reads
    goes by ``close``, by ``release`` of that result, or when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/siftlake-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.made: list[str] = []
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)  # by the JVM, so it holds after the session was stopped too
        bound_batches(spark)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def _mark(self, df: DataFrame, at: str) -> DataFrame:
        df._scratch = at
        self.made.append(at)
        return df

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and read it back; its columns keep their types."""
        at = self.path(name)
        out = df.write.option("compression", "zstd")
        if partition_by:
            out = out.partitionBy(*partition_by)
        out.parquet(at)
        return self._mark(self.spark.read.schema(df.schema).parquet(at), at)

    def buckets(self, size: int) -> int:
        """How many for ``size`` bytes: no fewer than shuffle partitions."""
        return min(100_000, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))

    def keep_bucketed(self, df: DataFrame, name: str, by: str | list[str], n: int) -> DataFrame:
        """Like ``keep`` in ``n`` buckets, sorted in them: joins and sums on ``by`` don't move it again.

        ``df`` has been dealt by ``repartition(n, by)``, so a bucket is one file. The
        catalog holds the table's name only while it is written.
        """
        at, by, table = self.path(name), [by] if isinstance(by, str) else by, "siftlake_" + uuid.uuid4().hex
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # one file, so its order holds
        out = df.write.bucketBy(n, *by).sortBy(*by)
        out.format("parquet").option("compression", "zstd").option("path", at).saveAsTable(table)
        kept = self.spark.table(table)
        kept.schema  # noqa: B018  resolved while the name is there
        self.spark.sql(f"DROP TABLE {table}")
        return self._mark(kept, at)

    def free(self) -> None:
        """Let go of finished shuffles: Spark deletes their files once the driver's JVM has collected the plans."""
        self.spark._jvm.java.lang.System.gc()

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` as a result that ``release`` can clear up after."""
        df._releases = self
        return df

    def only(self, *tables: DataFrame) -> None:
        """Delete all tables but these, which a result still reads."""
        need = {t._scratch for t in tables}
        for at in self.made:
            if at not in need:
                self._delete(at)
        self.made = [at for at in self.made if at in need]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for t in tables:
            self._delete(t._scratch)
            self.made.remove(t._scratch)

    def close(self) -> None:
        self._delete(self.root)

    def _at(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, at: str) -> None:
        fs, path = self._at(at)
        fs.delete(path, True)


def release(result: DataFrame) -> None:
    """Delete what a result of an operator reads, once it has been written or isn't wanted any more."""
    if scratch := getattr(result, "_releases", None):
        scratch.close()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from, as Spark knows them; sources of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """``f`` over every Arrow batch; it may return a batch, several, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = f(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return df.mapInArrow(run, schema)


def fold_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that names an operator uses can't clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def unfold_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from what ``fold_columns`` made."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in like.columns])


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    buffers = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    return [b or b"" for b in buffers.to_pylist()]


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star.

    ``edges`` holds pairs of longs; repeated pairs, loops and either direction
    are fine. Returns (node, component), component being the smallest node
    reachable, for every node of an edge that isn't a loop. A star's centre may
    have any number of leaves: its minimum is pre-aggregated before the shuffle,
    and the join that hands it back can be split by Spark when it is skewed.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.keep(pairs, "edges")

    def stars() -> bool:
        """Whether every node is either a centre, or the leaf of one centre and nothing else."""
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(now.select("v", F.lit(0), F.lit(1)))
        of = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        return not of.where("leaf > 1 OR leaf = 1 AND centre = 1").limit(1).count()

    while not stars():
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mid = scratch.keep(large, "large")
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = scratch.keep(small, "small")
        scratch.drop(now, mid)
        now = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def hash_frame(words: np.ndarray, multiplier: int) -> np.ndarray:
    """A 64-bit finaliser for hashes that come out of sums and products."""
    x = words * np.uint64(multiplier)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x
