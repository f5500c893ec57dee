import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake.plans import signal as sig
from siftlake.plans.loop import Loop, grid
from siftlake.sources import table


@pytest.fixture
def data(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, f"{'river' if i % 2 else 'stone'} word{i % 10} in the hills", i // 10, i % 10, [float(x) for x in rng.standard_normal(2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, episode long, step long, action array<float>")
    return table.create(df, str(tmp_path / "t"), "id")


def test_signal_filter_sample_tag(data, spark):
    @sig.signal("int32")
    def chars(text):
        return pa.compute.utf8_length(text)

    data.signal(chars=chars(), words=sig.length("text"))
    assert {r.words for r in data.df(["words"]).collect()} == {5}
    view = data.filter("text LIKE '%river%'")
    assert len(view) == 20
    view.signal(part=sig.n_chars("text"))
    assert data.df(["part"]).where("part IS NULL").count() == 20
    kept = data.dedup("text")
    assert len(kept) == 10
    few = kept.sample(4)
    assert len(few) == 4
    few.tag("few")
    again = table.load(spark, data.uri, tag="few")
    assert len(again) == 4 and again.where == few.where and [s["op"] for s in again.steps[-2:]] == ["sample", "filter"]
    assert "chars" in data.provenance() and data.recipe["columns"]["words"]["signal"] == "length"
    s = few.stats(["words", "is_dup"])
    assert s["rows"] == 4 and s["words"]["p50"] == 5 and s["is_dup"]["true"] == 0
    out = few.export(data.uri + "-out", ["text", "words"])
    assert len(out) == 4 and out.columns == ["text", "words"]
    with pytest.raises(ValueError):
        data.dedup("text")
    data.drop("words", "nothing")
    assert "words" not in data.columns


def test_pin_and_resume(data, spark):
    v = data.version
    pinned = table.load(spark, data.uri, version=v)
    data.filter("step < 3").signal(n=sig.length("text"))
    assert "n" not in pinned.columns and "n" not in pinned.filter("id > 3").columns
    data.signal(n=sig.length("text"))
    assert data.df(["n"]).where("n = 5").count() == 40
    last = data.version
    data.signal(n=sig.length("text"))  # nothing is null any more
    assert data.version == last
    empty = data.filter("id < 0").signal(m=sig.length("text"))
    assert len(empty) == 0 and data.df(["m"]).where("m IS NOT NULL").count() == 0


def test_group_signals(data):
    class first_step(sig.GroupSignal):
        dtype = "int64"

        def compute(self, step):
            return step[0].as_py()

    g = data.group("episode", "step")
    assert len(g) == 4
    g.signal(ep_len=sig.Group("length"), jerk=sig.Group("jerk", "action"), idle=sig.Group("idle_fraction", "action"), path=sig.Group("path_length", "action"), first=first_step("step"))
    assert g.stats(["ep_len"])["ep_len"]["mean"] == 10
    rows = data.to_pandas(["episode", "step", "action", "jerk", "path", "first"]).sort_values(["episode", "step"])
    for _, e in rows.groupby("episode"):
        a = np.array(e.action.tolist())
        assert abs(np.linalg.norm(np.diff(a, n=2, axis=0), axis=1).mean() - e.jerk.iloc[0]) < 1e-5
        assert abs(np.linalg.norm(np.diff(a, axis=0), axis=1).sum() - e.path.iloc[0]) < 1e-4
        assert set(e["first"]) == {0}
    assert 0 < len(g.filter("jerk < 100")) <= 40


def test_loop_in_tags(data):
    seen = []

    def train(view, name):
        seen.append(name)
        return float(len(view))

    make = lambda ws, n: Loop(data, train, grid(ws), minimize=False, budget=n, min_rows=2)
    make(["TRUE", "step < 5"], 2).run()
    tree = make(["TRUE", "step < 5", "step < 0", "no_such_column = 1", "id = 1"], 9).run()
    assert seen == ["trial_0", "trial_1"] and [t.score for t in tree[:2]] == [40.0, 20.0] and tree[0].where == "TRUE"
    assert sum("error" in t.metrics for t in tree) == 3 and len(tree) == 5


def test_search_and_batches(data):
    found = data.filter("episode = 1").search("river word3", "text", limit=3).collect()
    assert found[0].text.startswith("river word3") and found[0]._score >= found[-1]._score
    assert data.search("", "text").count() == 0
    parts = [[r["id"] for b in data.batches(["id"], 7, seed=1, rank=r, world=2) for r in b.to_pylist()] for r in range(2)]
    assert sorted(parts[0] + parts[1]) == list(range(40)) and parts[0] != sorted(parts[0])
    resumed = [r["id"] for b in data.batches(["id"], 7, seed=1, rank=0, world=2, skip=1) for r in b.to_pylist()]
    assert resumed == parts[0][7:]
    assert data.head(3).num_rows == 3 and data.to_table(["id"], 5).num_rows == 5
