"""Row-wise signals, contamination and exact dedup on streams.

Signals and lookups in a static bank keep no state and run on a stream as they
stand. Exact dedup keeps the keys of the watermark's span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import bank_flags, dedup_key
from siftlake.plans.signal import Signal


def with_signals(stream: DataFrame, **signals: Signal) -> DataFrame:
    return stream.withColumns({n: s.column() for n, s in signals.items()})


def contaminated(stream: DataFrame, column: str, bank: DataFrame, bank_column: str, ngram: int = 13, name: str = "contaminated") -> DataFrame:
    """Flag rows of a stream that share a word n-gram with a static bank, whose texts go to each task."""
    held = tuple(sorted({r.t for r in bank.select(F.col(bank_column).alias("t")).where("t IS NOT NULL").collect()}))
    flag = F.arrow_udf(lambda x: bank_flags(x, held, ngram), "boolean")
    return stream.withColumn(name, F.coalesce(flag(F.col(column)), F.lit(False)))


def drop_exact_dups(stream: DataFrame, column: str, time: str, delay: str) -> DataFrame:
    """The first row of each content within the watermark."""
    keyed = stream.withColumn("_h", dedup_key(F.col(column), dict(stream.dtypes)[column]))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")
