"""A versioned table on Parquet: derived columns beside the base, views, tags, provenance.

Layout under a table's path::

    base/                 rows as created, with the key ``_row_id``
    columns/ID/           derived columns of one commit: ``_row_id`` and values
    _versions/000001.json which folders make up the table, column by column
    _tags/NAME.json       a name for a version and a filter

A commit creates the next manifest under its final name and fails if another writer
has made it, so no commit is lost; a manifest or tag is read only once it is whole.
Columns are
added without rewriting the base, and a scan joins only the folders of columns
that it is asked for. All paths go through Spark's file systems.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from siftlake.operators import measure, select
from siftlake.plans.signal import Group, GroupSignal, Signal

KEY = "_row_id"


class Files:
    """Small text files on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self.fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> dict:
        for last in (False,) * 20 + (True,):
            stream = self.fs.open(self._path(name))
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:  # another writer is at it
                if last:
                    raise
                time.sleep(0.1)
            finally:
                stream.close()
        raise AssertionError

    def write(self, name: str, value: dict, replace: bool = False) -> None:
        """Create ``name``; unless ``replace``, only one of several writers succeeds."""
        try:
            out = self.fs.create(self._path(name), replace)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.fs.exists(self._path(name)):
                raise FileExistsError(f"{name}: another writer was first") from e
            raise
        out.write(bytearray(json.dumps(value, default=str).encode()))
        out.close()

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []


def create(df: DataFrame, uri: str, key: str | None = None) -> Dataset:
    """A table of the rows of ``df``; ``key`` names a column that is unique, else rows are numbered once."""
    spark = df.sparkSession
    row = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    df.select(row.alias(KEY), *df.columns).write.parquet(f"{uri}/base")
    _commit(Files(spark, uri), 1, {"base": ["base"], "schema": json.loads(df.schema.json()), "columns": {}})
    return Dataset(spark, uri)


def load(spark: SparkSession, uri: str, tag: str | None = None, version: int | None = None, where: str | None = None) -> Dataset:
    """Open a table, a version of it, or what a tag names (which then decides all else)."""
    if tag:
        recipe = Files(spark, uri).read(f"_tags/{tag}.json")["recipe"]
        return Dataset(spark, uri, recipe["version"], recipe["where"], recipe["steps"])
    return Dataset(spark, uri, version, where)


def _commit(files: Files, version: int, manifest: dict) -> None:
    files.write(f"_versions/{version:06d}.json", manifest | {"version": version, "time": time.time()})


class Dataset:
    """A view: a table, perhaps a pinned version, and a filter."""

    def __init__(self, spark: SparkSession, uri: str, version: int | None = None, where: str | None = None, steps: list | None = None):
        self.spark, self.uri, self.where, self.steps = spark, uri.rstrip("/"), where, list(steps or [])
        self.files, self._pin = Files(spark, self.uri), version

    # ---- metadata
    @property
    def version(self) -> int:
        return self._pin or int(self.files.names("_versions")[-1][:6])

    @property
    def manifest(self) -> dict:
        return self.files.read(f"_versions/{self.version:06d}.json")

    @property
    def schema(self) -> StructType:
        m = self.manifest
        base = StructType.fromJson(m["schema"])
        return StructType([*base.fields, *(StructField.fromJson(c["field"]) for c in m["columns"].values())])

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def __repr__(self) -> str:
        return f"Dataset({len(self)} rows, {len(self.columns)} cols, v{self.version}, where={self.where})"

    def provenance(self) -> dict[str, dict]:
        return {f.name: f.metadata["provenance"] for f in self.schema if "provenance" in f.metadata}

    @property
    def recipe(self) -> dict:
        return {"uri": self.uri, "version": self.version, "where": self.where, "steps": self.steps, "columns": {k: json.loads(v) for k, v in self.provenance().items()}}

    def timings(self) -> dict[str, dict]:
        """What each column took, and how many rows, duplicates, clusters and groups it met."""
        keys = ("signal", "rows", "seconds", "dups", "clusters", "groups")
        return {c: {k: v for k, v in json.loads(p).items() if k in keys} for c, p in self.provenance().items()}

    # ---- reading
    def _all(self, columns: list[str]) -> DataFrame:
        """The rows with the columns asked for and those the filter may name; nothing else is joined."""
        m = self.manifest
        named = {w.lower() for w in re.findall(r"\w+", self.where or "")}
        want = [c for c in self.columns if c in columns or c.lower() in named]
        base = [f["name"] for f in m["schema"]["fields"]]
        df = self.spark.read.parquet(*[f"{self.uri}/{b}" for b in m["base"]]).select(KEY, *[c for c in want if c in base])
        by_parts: dict[tuple, list[str]] = {}
        for c in want:
            if c in m["columns"]:
                by_parts.setdefault(tuple(m["columns"][c]["parts"]), []).append(c)
        for parts, names in by_parts.items():
            side = None
            for i, p in enumerate(parts):
                part = self.spark.read.parquet(f"{self.uri}/{p}").select(KEY, *names)
                # a later part fills what was null, so parts don't overlap
                part = part if i == len(parts) - 1 else part.dropna("all", subset=names)
                side = part if side is None else side.unionByName(part)
            df = df.join(side, KEY, "left")
        for f in self.schema:
            if f.name in want and f.metadata:
                df = df.withMetadata(f.name, f.metadata)
        return df

    def _rows(self, columns: list[str]) -> DataFrame:
        df = self._all(columns)
        return df.where(self.where) if self.where else df

    def df(self, columns: list[str] | None = None) -> DataFrame:
        """The view as a DataFrame."""
        columns = columns or self.columns
        return self._rows(columns).select(*columns)

    def drop_null(self, columns: list[str] | None = None) -> DataFrame:
        """The view without rows that have a null in any of the columns."""
        return self.df(columns).dropna("any")

    def __len__(self) -> int:
        return self._rows([]).count()

    def head(self, n: int = 5, columns: list[str] | None = None):
        return self.df(columns).limit(n).toArrow()

    def to_table(self, columns: list[str] | None = None, limit: int | None = None):
        df = self.df(columns)
        return (df if limit is None else df.limit(limit)).toArrow()

    def to_pandas(self, columns: list[str] | None = None, limit: int | None = None):
        df = self.df(columns)
        return (df if limit is None else df.limit(limit)).toPandas()

    # ---- views
    def filter(self, where: str) -> Dataset:
        both = f"({self.where}) AND ({where})" if self.where else where
        return Dataset(self.spark, self.uri, self._pin, both, [*self.steps, {"op": "filter", "where": where}])

    def group(self, key: str, order: str | None = None) -> Grouped:
        return Grouped(self, key, order)

    # ---- writing
    def _add(self, rows: DataFrame, names: dict[str, dict], started: float, fill: bool = False, counts: dict | None = None) -> None:
        """Commit columns of ``rows``; with ``fill`` they extend columns that are there. ``counts`` are aggregates to record."""
        part = f"columns/{uuid.uuid4().hex}"
        rows.select(KEY, *names).write.parquet(f"{self.uri}/{part}")
        files = Files(self.spark, self.uri)
        last = int(files.names("_versions")[-1][:6])
        m = files.read(f"_versions/{last:06d}.json")
        done = self.spark.read.parquet(f"{self.uri}/{part}")
        met = done.agg(F.count(F.lit(1)).alias("rows"), *[x.alias(k) for k, x in (counts or {}).items()]).first().asDict()
        for c, info in names.items():
            info = info | met | {"seconds": round(time.time() - started, 3), "where": self.where}
            field = StructField(c, rows.schema[c].dataType, True, {"provenance": json.dumps(info, default=str)})
            if fill:
                m["columns"][c]["parts"].append(part)
            else:
                m["columns"][c] = {"parts": [part], "field": json.loads(field.json())}
        _commit(files, last + 1, m)
        self._pin = None

    def signal(self, **signals: Signal) -> Dataset:
        """Add columns for the rows of this view: new ones in one pass, started ones where they are null."""
        have = set(self.columns)
        new = {n: s for n, s in signals.items() if n not in have}
        if new:
            started = time.time()
            rows = self._rows([i for s in new.values() for i in s.inputs])
            self._add(rows.select(KEY, *[s.column().alias(n) for n, s in new.items()]), {n: s.describe() for n, s in new.items()}, started)
        for name, s in signals.items():
            if name in have:
                started = time.time()
                rows = self._rows([*s.inputs, name]).where(F.col(name).isNull())
                if rows.limit(1).count():
                    self._add(rows.select(KEY, s.column().alias(name)), {name: s.describe()}, started, fill=True)
        return self

    def _free(self, *names: str) -> None:
        for n in names:
            if n in self.columns:
                raise ValueError(f"column {n} exists")

    def dedup(self, column: str | Signal, threshold: float | None = None, name: str = "is_dup", embedding_column: str = "embedding", **kw) -> Dataset:
        """Flag duplicates of this view and return what isn't flagged: exact, or semantic with a threshold."""
        cluster = kw.get("cluster_column", "cluster")
        self._free(name, *([cluster] if threshold is not None else []))
        if isinstance(column, Signal):
            self.signal(**{embedding_column: column})
            column = embedding_column
        started, rows = time.time(), self._rows([column])
        info = {"signal": "dedup", "inputs": [column], "threshold": threshold} | kw
        if threshold is None:
            self._add(select.exact_dup(rows, column, KEY, name).select(KEY, name), {name: info}, started, counts={"dups": F.count_if(F.col(name))})
        else:
            self._add(select.semantic_dup(rows, column, KEY, threshold, name=name, **kw).select(KEY, name, cluster), {name: info, cluster: info}, started, counts={"dups": F.count_if(F.col(name)), "clusters": F.count_distinct(F.when(F.col(cluster) >= 0, F.col(cluster)))})
        self.steps.append({"op": "dedup", "column": column, "threshold": threshold, "name": name})
        return self.filter(f"NOT {name}")

    def sample(self, n: int, seed: int = 0, by: str | None = None, name: str | None = None) -> Dataset:
        name = name or f"sample_{n}"
        self._free(name)
        started = time.time()
        rows = select.sample(self._rows([by] if by else []), KEY, n, seed, by, name)
        self._add(rows.select(KEY, name), {name: {"signal": "sample", "inputs": [by] if by else [], "n": n, "seed": seed}}, started)
        self.steps.append({"op": "sample", "n": n, "seed": seed, "by": by, "name": name})
        return self.filter(name)

    def drop(self, *columns: str) -> Dataset:
        """Take columns out of the table; names it lacks are ignored."""
        files = Files(self.spark, self.uri)
        last = int(files.names("_versions")[-1][:6])
        m = files.read(f"_versions/{last:06d}.json")
        m["columns"] = {k: v for k, v in m["columns"].items() if k not in columns}
        m["schema"]["fields"] = [f for f in m["schema"]["fields"] if f["name"] not in columns]
        _commit(files, last + 1, m)
        self._pin = None
        self.steps.append({"op": "drop", "columns": list(columns)})
        return self

    def tag(self, name: str, **extra) -> dict:
        """Name this version and filter; ``extra`` is kept beside the recipe."""
        recipe = self.recipe
        self.files.write(f"_tags/{name}.json", {"recipe": recipe} | extra, replace=True)
        return recipe

    def tags(self) -> dict[str, dict]:
        return {n[:-5]: self.files.read(f"_tags/{n}") for n in self.files.names("_tags") if n.endswith(".json")}

    def export(self, path: str, columns: list[str] | None = None) -> Dataset:
        """Write the view as a table of its own."""
        df = self.df(columns)
        spark = self.spark
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        out = create(df, path)
        out.steps = [*self.steps, {"op": "export", "from": self.recipe}]
        return out

    # ---- reports
    def stats(self, columns: list[str] | None = None) -> dict:
        return measure.stats(self.df(columns or [f.name for f in self.schema if measure.summarizable(f)]), columns)

    def search(self, query: str, column: str, limit: int = 10, columns: list[str] | None = None) -> DataFrame:
        columns = columns or self.columns
        found = measure.search(self._rows([*columns, column]), query, column, KEY, limit)
        return found.select(*columns, "_score")

    def batches(self, columns: list[str] | None = None, batch_size: int = 1024, seed: int = 0, epoch: int = 0, rank: int = 0, world: int = 1, skip: int = 0):
        """Arrow batches in a seeded order for one of ``world`` readers; ``skip`` batches are passed over to resume.

        Rows are dealt to tasks by the hash of seed, epoch and key and sorted there;
        tasks hand over whole Arrow batches, one task's result at a time.
        """
        import pyarrow as pa

        columns = columns or self.columns
        h = F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(KEY).cast("string")).cast("binary"))
        mine = F.pmod(F.xxhash64(F.lit(seed), KEY), F.lit(world)) == rank
        df = self._rows(columns).where(mine).select(*columns, h.alias("_order"), F.col(KEY)).repartitionByRange("_order", KEY).sortWithinPartitions("_order", KEY).select(*columns)

        def packed(parts):
            for b in parts:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["b"])

        held: list[pa.Table] = []
        rows = 0
        for r in df.mapInArrow(packed, "b binary").toLocalIterator(prefetchPartitions=True):
            part = pa.ipc.open_stream(r.b).read_all()
            held.append(part)
            rows += part.num_rows
            while rows >= batch_size:
                whole = pa.concat_tables(held)
                if skip:
                    skip -= 1
                else:
                    yield whole.slice(0, batch_size).combine_chunks().to_batches()[0]
                held = [whole.slice(batch_size)]
                rows -= batch_size
        if rows and not skip:
            yield pa.concat_tables(held).combine_chunks().to_batches()[0]


class Grouped:
    """The rows of a view by a key, in order."""

    def __init__(self, data: Dataset, key: str, order: str | None):
        self.data, self.key, self.order = data, key, order

    def __len__(self) -> int:
        return measure.group_count(self.data.df([self.key]), self.key)

    def signal(self, **signals: GroupSignal | Group) -> Grouped:
        """One value for each group, on all its rows; groups whose value is null are computed again."""
        d = self.data
        for name, s in signals.items():
            started, inputs = time.time(), s.describe()["inputs"]
            fill = name in d.columns
            order = [c for c in (self.order,) if c] or [KEY]
            rows = d._rows([self.key, *inputs, *order[:1], *([name] if fill else [])])
            if fill:
                rows = rows.where(F.col(name).isNull()).drop(name)
                if not rows.limit(1).count():
                    continue
            if isinstance(s, Group):
                out = s.plan(rows, self.key, order, name)
            else:
                out = self._udf(rows, s, order, name)
            d._add(out.select(KEY, name), {name: s.describe()}, started, fill)
        return self

    def _udf(self, rows: DataFrame, s: GroupSignal, order: list[str], name: str) -> DataFrame:
        import pyarrow as pa

        inputs, kind = s.inputs or [self.key], s.spark_type.simpleString()

        def run(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by([(c, "ascending") for c in order])
            v = s.value(*[group.column(c).combine_chunks() for c in inputs])
            return pa.table({KEY: group.column(KEY), name: pa.array([v] * group.num_rows)})

        return rows.groupBy(self.key).applyInArrow(run, f"{KEY} long, {name} {kind}")

    def stats(self, columns: list[str] | None = None) -> dict:
        d = self.data
        columns = columns or [f.name for f in d.schema if measure.summarizable(f) and f.name != self.key and "provenance" in f.metadata]
        return measure.grouped_stats(d.df([self.key, *columns]), self.key, columns)

    def filter(self, where: str) -> Dataset:
        return self.data.filter(where)
