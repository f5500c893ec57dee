"""The pipeline from end to end on small inputs, and what operators leave behind."""

import glob
import zlib

import corpus_pipeline
import numpy as np
import pytest
from siftlake.llm import common
from siftlake.llm.grid_join import near_vectors
from siftlake.llm.line_dedup import dedup_lines
from siftlake.llm.minhash import near_duplicates
from siftlake.llm.packing import encoder
from siftlake.llm.suffix_dedup import drop_repeats
from tests.llm import brute
from tests.llm.test_operators import corpus, frame

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, at, rows, labels):
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def folders(spark):
    return set(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/siftlake-*"))


def test_pipeline(spark, tmp_path):
    """Without labels the classifier keeps all; each later stage is held against its slow version on its own input."""
    docs = corpus(seed=3, n=30) + [(1000, None), (1001, "")]
    at = write(spark, tmp_path, docs, [])
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name in names[:-1]:
        out = stages[name](spark, now, at)
        assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name[:4]}")
        common.release(out)
        now = spark.read.parquet(f"{tmp_path}/{name[:4]}")
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert seen["quality classifier"] == dict(docs)
    lines = sorted(seen["line dedup"].items())
    comp = brute.near_duplicates(lines, 5, 80)
    assert set(seen["MinHash near-dedup"]) == {k for k, (_, c) in comp.items() if k == c}
    cut = brute.repeats(list(seen["MinHash near-dedup"].items()), 100)
    assert {k: t or "" for k, t in seen["suffix-array dedup"].items()} == {k: v[3].decode("utf-8", "ignore") for k, v in cut.items()}
    before = folders(spark)
    packed = corpus_pipeline.run(spark, at)
    got = {}
    for r in packed.collect():
        got.setdefault(r.doc_id, []).append(r)
    enc, end = encoder(corpus_pipeline.TOKENIZER), np.array([2], "<u4").tobytes()
    for k, t in seen["suffix-array dedup"].items():
        ids = enc.whole(t or "") + end
        assert sum(r.length for r in got[k]) == len(ids) // 4 and all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in got[k])
    assert set(got) == set(seen["suffix-array dedup"])
    assert len(folders(spark) - before) == 1  # what the result reads
    common.release(packed)
    assert folders(spark) == before


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "none", [], [])).count() == 0


def test_nothing_is_left(spark):
    """After ``release`` neither a folder nor a name in the catalog."""
    before, names = folders(spark), {t.name for t in spark.catalog.listTables()}
    docs = frame(spark, corpus(n=5))
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    for made in (lambda: drop_repeats(docs, digest=True), lambda: near_duplicates(docs), lambda: dedup_lines(docs, digest=True), lambda: near_vectors(vectors)):
        out = made()
        assert out.count() and len(folders(spark) - before) == 1
        assert {t.name for t in spark.catalog.listTables()} == names
        common.release(out)
        assert folders(spark) == before


def test_no_local_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda name, other: other)

    session = type("S", (), {"conf": Conf(), "sparkContext": type("C", (), {"master": "spark://host:7077"})()})()
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(session)
