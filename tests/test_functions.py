import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.functions import grouped, media, text, vectors
from siftlake.operators import measure, select
from siftlake.plans import signal as sig
from siftlake.streaming import signals as streams


def test_text_edges(spark):
    rows = [(1, "a b\tc"), (2, ""), (3, None), (4, "a\x0bb c d"), (5, "a b \x1f c"), (6, " a  b c "), (7, "A b c")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r for r in df.select("id", text.length(F.col("t")).alias("n"), text.is_val(F.col("id"), 2).alias("v")).collect()}
    assert [got[i].n for i in range(1, 8)] == [3, 0, None, 2, 3, 3, 3]
    dup = {r.id: r.is_dup for r in select.exact_dup(df, "t", "id").collect()}
    assert dup == {1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False}


def test_ngrams(spark):
    df = spark.createDataFrame([("One two three four",), ("one  TWO",), ("",), (None,)], "t string")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    got = [r[0] for r in df.select(text.ngrams(F.col("t"), 3)).collect()]
    assert got[0] == [md5("one two three"), md5("two three four")] and got[1] == [md5("one two")] and not got[2] and not got[3]


def test_contaminated_short(spark):
    bank = spark.createDataFrame([("alpha beta",)], "t string")
    df = spark.createDataFrame([(1, "alpha beta"), (2, "x alpha beta y"), (3, None)], "id int, t string")
    assert {r.id: r.contaminated for r in select.contaminated(df, "t", bank, "t", "id", 3).collect()} == {1: True, 2: False, 3: False}
    assert [r[0] for r in df.orderBy("id").select(sig.contaminated("t", ["alpha beta"], 3).column()).collect()][:2] == [True, False]


def test_stats_nan_null(spark):
    df = spark.createDataFrame([(1.0, 1, True, "a"), (float("nan"), 2, None, None), (3.0, None, False, "a")], "x double, n int, b boolean, s string")
    s = measure.stats(df)
    assert math.isnan(s["x"]["mean"]) and s["x"]["max"] == 3.0 and s["x"]["p50"] == 2.0 and s["x"]["nulls"] == 0
    assert s["n"] == {"mean": 1.5, "min": 1, "max": 2, "p5": 1, "p25": 1, "p50": 1, "p75": 1, "p95": 1, "nulls": 1} and s["b"] == {"true": 1, "frac": 0.5, "nulls": 1}
    assert measure.stats(df, ["s"])["s"] == {"distinct": 2, "top": {"a": 2, None: 1}, "nulls": 1}
    empty = measure.stats(df.where("false"))
    assert empty["rows"] == 0 and empty["x"]["p50"] is None and empty["b"]["true"] == 0


def test_group_edges(spark):
    rows = [(1, 0, [0.0, 0.0], None, 1.0), (2, 1, [1.0, 0.0], True, None), (2, 0, [0.0, 0.0], False, 2.0), (3, 0, [0.0], False, 5.0), (3, 1, [0.0], None, 4.0), (3, 2, [3.0], None, 4.0), (None, 0, [1.0], None, 1.0)]
    df = spark.createDataFrame(rows, "ep int, step int, a array<double>, flag boolean, r double")
    m = grouped.steps(df, "ep", "step", "a")
    got = {r.ep: r for r in m.select("ep", grouped.length("ep").alias("n"), grouped.jerk("ep").alias("j"), grouped.idle_fraction("ep").alias("i"), grouped.path_length("ep").alias("p"), grouped.success("ep", "flag").alias("s"), grouped.peak("ep", "r").alias("k")).distinct().collect()}
    assert (got[1].j, got[1].i, got[1].p, got[1].s) == (0, 1, 0, False) and got[2].p == 1 and got[2].s and math.isnan(got[2].k)
    assert got[3].j == 3 and got[3].i == 0.5 and got[3].k == 5 and got[None].n == 1


def test_semantic_invariants(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 8))
    v = np.concatenate([base, base + 0.01 * rng.standard_normal((30, 8)), np.zeros((1, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id int, v array<double>")
    out = {r.id: r for r in select.semantic_dup(df, "v", "id", 0.95).collect()}
    assert len(out) == 62 and out[60].cluster == -1 and not out[60].is_dup and not out[99].is_dup
    u = v[:60] / np.linalg.norm(v[:60], axis=1, keepdims=True)
    kept = [i for i in range(60) if not out[i].is_dup]
    for i in kept:
        assert not any(out[i].cluster == out[j].cluster and u[i] @ u[j] > 0.95 for j in kept if j != i)
    for i in set(range(60)) - set(kept):
        assert any(out[i].cluster == out[j].cluster and u[i] @ u[j] > 0.95 for j in range(60) if j != i)


def test_sample_exact(spark):
    df = spark.createDataFrame([(i, "a" if i < 80 else "b" if i < 83 else None) for i in range(90)], "id int, g string")
    n = lambda d, c: d.where(c).groupBy("g").count().collect()
    by = {r.g: r["count"] for r in n(select.sample(df, "id", 20, by="g"), "sample_20")}
    assert by[None] == 7 and by["b"] == 3 and by["a"] == 10
    assert select.sample(df, "id", 500).where("sample_500").count() == 90
    one = {r.id for r in select.sample(df, "id", 9, seed=1).where("sample_9").collect()}
    assert len(one) == 9 and one == {r.id for r in select.sample(df.repartition(3), "id", 9, seed=1).where("sample_9").collect()}
    with pytest.raises(ValueError):
        select.sample(df, "id", 3, name="not a name")


def test_media(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 10
    df = spark.createDataFrame([(png,), (jpg,), (b"GIF89a\x05\0\x06\0",), (b"junk",), (None,)], "b binary")
    got = [tuple(r) for r in df.select(media.resolution_of_bytes("b"), media.decode_ok("b")).collect()]
    assert got == [(20, True), (7, True), (5, True), (None, False), (None, False)]
    clip = np.concatenate([np.zeros((4, 8, 8, 3)), np.full((4, 8, 8, 3), 200)])
    assert media.scene_cuts_of(clip) == 1 and abs(media.motion_of(clip) - 200 / 255 / 7) < 1e-6 and media.motion_of(clip[:1]) == 0
    assert media.frame_indices(10, 4) == [0, 3, 6, 9] and abs(media.video_clip_score(np.eye(2), np.array([1, 0])) - 0.7071) < 1e-3
    v = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = v.select(vectors.clip_score(F.col("a"), F.col("b")), vectors.aesthetic(F.col("a"), [1, 2], 1.0), vectors.normalise(F.col("z")), text.padded(F.array(F.lit(5)), 3)).first()
    assert abs(r[0] - 1) < 1e-6 and abs(r[1] - 3.2) < 1e-6 and r[2] == [0, 0] and r[3] == [5, 0, 0]


def test_retrieval(spark):
    sims = spark.createDataFrame([(q, i, 1.0 if (q, i) != (1, 1) else 0.5) for q in range(2) for i in range(3)], "q int, i int, s double")
    r = measure.recall_at(sims, "q", "i", "s").first()
    assert (r.r1, r.r5) == (50, 100)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "2024-01-01"), (2, "a  b", "2024-01-01"), (3, "one two", "2024-01-01")], "id int, t string, d string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t string, d string").parquet(str(tmp_path / "in")).withColumn("time", F.to_timestamp("d"))
    bank = spark.createDataFrame([("one two",)], "t string")
    made = streams.contaminated(streams.with_signals(streams.drop_exact_dups(stream, "t", "time", "1 day"), n=sig.length("t")), "t", bank, "t", 2)
    q = made.writeStream.format("memory").queryName("made").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("made").collect()
    assert len(rows) == 2 and {r.n for r in rows} == {2} and {r.id: r.contaminated for r in rows}[3]
