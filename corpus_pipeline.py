"""A corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and rereads it for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftlake.llm.common import Scratch, release
from siftlake.llm.line_dedup import dedup_lines
from siftlake.llm.minhash import drop_near_duplicates
from siftlake.llm.packing import pack
from siftlake.llm.quality import keep_quality
from siftlake.llm.suffix_dedup import drop_repeats

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds are dropped from the text."""
    return dedup_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on shingles of five words."""
    return drop_near_duplicates(docs, words=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stood earlier are cut from the text."""
    return drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024."""
    return pack(docs, TOKENIZER, capacity=1024, end=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near),
    ("suffix-array dedup", passages),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # SQL can't express the classifier and the packing


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read is deleted once its result is written."""
    scratch, last = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = scratch.keep(made, name.replace(" ", "-"))
        release(made)
        if last is not None:
            scratch.drop(last)
        last = docs
    name, stage = STAGES[-1]
    made = stage(spark, docs, sf_dir)
    out = scratch.keep(made, name.replace(" ", "-"))
    release(made)
    scratch.only(out)
    return scratch.result(out)
