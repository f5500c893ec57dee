"""Per-group signals over ordered rows, as window expressions.

``steps`` adds differences along the order; the aggregates then share its
partitioning, so a group costs one exchange and one sort. Vectors may be arrays
or plain numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.vectors import difference, norm


def _vector(df: DataFrame, name: str) -> Column:
    return F.col(name) if dict(df.dtypes)[name].startswith("array") else F.array(F.col(name))


def steps(df: DataFrame, key: str, order: str | list[str], column: str, prefix: str = "_") -> DataFrame:
    """Norms of the first and second difference of ``column`` within its group."""
    w = Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))
    v = _vector(df, column)
    one, two = F.lag(v, 1).over(w), F.lag(v, 2).over(w)
    second = F.zip_with(difference(v, one), difference(one, two), lambda x, y: x - y)
    return df.withColumns({f"{prefix}d1": F.when(one.isNotNull(), norm(difference(v, one))), f"{prefix}d2": F.when(two.isNotNull(), norm(second))})


def _over(key: str):
    return Window.partitionBy(key)


def length(key: str) -> Column:
    return F.count(F.lit(1)).over(_over(key)).cast("int")


def jerk(key: str, prefix: str = "_") -> Column:
    """Mean norm of the second difference; 0 with fewer than three rows."""
    return F.coalesce(F.avg(f"{prefix}d2").over(_over(key)), F.lit(0.0)).cast("float")


def idle_fraction(key: str, eps: float = 1e-3, prefix: str = "_") -> Column:
    """Share of steps shorter than ``eps``; 1 with a single row."""
    still = (F.col(f"{prefix}d1") < eps).cast("double")
    return F.coalesce(F.avg(still).over(_over(key)), F.lit(1.0)).cast("float")


def path_length(key: str, prefix: str = "_") -> Column:
    return F.coalesce(F.sum(f"{prefix}d1").over(_over(key)), F.lit(0.0)).cast("float")


def success(key: str, flag: str) -> Column:
    """Whether any flag is true; null is false."""
    return F.coalesce(F.bool_or(F.col(flag)).over(_over(key)), F.lit(False))


def peak(key: str, value: str) -> Column:
    """The largest value; NaN if any is null or NaN."""
    missing = F.max(F.col(value).isNull()).over(_over(key))
    return F.when(missing, F.lit(float("nan"))).otherwise(F.max(F.col(value).cast("double")).over(_over(key))).cast("float")
