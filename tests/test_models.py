"""Models of the caller's, proposers, hand-off of batches, and edges of select and measure."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from siftlake.functions.text import GramBank, bank_flags
from siftlake.operators import measure, select
from siftlake.operators.blocks import block_pairs
from siftlake.plans import loop
from siftlake.plans import signal as sig
from siftlake.sources import table
from siftlake.streaming import signals as streams


class Upper:
    """A model that is loaded once in a task."""

    def __call__(self, texts):
        return [("up" if t.isupper() else "low", 0.9 if t else 0.1) for t in texts]


@pytest.fixture
def docs(spark):
    rows = [(1, "A B"), (2, "a b"), (3, None), (4, ""), (5, "a  b"), (None, "a b"), (None, "only here")]
    return spark.createDataFrame(rows, "id long, text string").repartition(2)


def test_models(docs):
    got = {r.text: r.x for r in docs.select("text", sig.language("text", model="tests.test_models:Upper").column().alias("x")).collect()}
    assert got["A B"] == "up" and got["a b"] == "low" and got[""] == "und" and got[None] is None
    got = docs.select("text", sig.quality("text", model=lambda texts: [len(t) for t in texts]).column().alias("x"), sig.embed("text", model=lambda texts: np.array([[len(t), 4] for t in texts])).column().alias("v")).collect()
    assert {r.text: r.x for r in got}["A B"] == 3.0 and [round(x, 4) for r in got if r.text == "A B" for x in r.v] == [0.6, 0.8]
    assert sig.language("text", model=Upper).describe() == {"signal": "language", "inputs": ["text"], "min_confidence": 0.5, "model": "Upper"}


def test_null_keys(docs):
    got = sorted((r.id or 0, r.text or "", r.is_dup) for r in select.exact_dup(docs, "text", "id").collect())
    assert got == [(0, "a b", False), (0, "only here", False), (1, "A B", False), (2, "a b", True), (3, "", False), (4, "", False), (5, "a  b", True)]


def test_bank():
    bank = GramBank(["one two three four", "short", None, "", "x y"], 3)
    assert bank.flags(["Two  THREE four five", "one two", "short", "a short", None, "", "x y", "x y z", "one two x three four", "zero one two three"]) == [True, False, True, False, None, False, True, False, False, True]
    assert GramBank([], 3).flags(["a b c d"]) == [False] and bank.flags([]) == []
    many = ["w" + str(i) for i in range(50)]
    assert bank.flags([" ".join(many), "two three", "four"]) == [False, False, False]  # no gram crosses from text to text


def test_contaminated_both_ways(docs, spark, monkeypatch):
    bank = spark.createDataFrame([("A b",), (None,)], "t string")
    one = {(r.id, r.text, r.contaminated) for r in select.contaminated(docs.where("id IS NOT NULL"), "text", bank, "t", "id", 5).collect()}
    monkeypatch.setattr(select, "BANK_BYTES", -1)
    two = {(r.id, r.text, r.contaminated) for r in select.contaminated(docs.where("id IS NOT NULL"), "text", bank, "t", "id", 5).collect()}
    assert one == two == {(1, "A B", True), (2, "a b", True), (3, None, False), (4, "", False), (5, "a  b", True)}


def test_contaminated_stream(spark, tmp_path):
    spark.createDataFrame([(1, "x y z"), (2, "q")], "id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in")
    out = streams.contaminated(stream, "text", spark.createDataFrame([("y z",)], "t string"), "t", 2)
    out.writeStream.format("memory").queryName("flagged").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.table("flagged").collect()) == [(1, "x y z", True), (2, "q", False)]


def test_batches_counts_and_timings(spark, tmp_path):
    d = table.create(spark.range(250).selectExpr("id", "concat('t', id % 100) AS text"), str(tmp_path / "t"), "id")
    one = list(d.batches(["id"], batch_size=60, seed=3))
    assert all(isinstance(b, pa.RecordBatch) for b in one) and [b.num_rows for b in one] == [60, 60, 60, 60, 10]
    order = [x for b in one for x in b.column("id").to_pylist()]
    assert sorted(order) == list(range(250)) and order != sorted(order) and order == [x for b in d.batches(["id"], batch_size=60, seed=3) for x in b.column("id").to_pylist()]
    assert [x for b in d.batches(["id"], batch_size=60, seed=3, skip=2) for x in b.column("id").to_pylist()] == order[120:]
    parts = [[x for b in d.batches(["id"], seed=3, rank=r, world=2) for x in b.column("id").to_pylist()] for r in (0, 1)]
    assert sorted(parts[0] + parts[1]) == list(range(250)) and min(map(len, parts)) > 80
    assert len(d.dedup("text")) == 100
    took = d.timings()["is_dup"]
    assert took["dups"] == 150 and took["rows"] == 250 and took["signal"] == "dedup"
    with pytest.raises(FileExistsError):
        d.files.write("_versions/000001.json", {})


def test_proposers(spark, tmp_path):
    d = table.create(spark.range(40).selectExpr("id", "id % 4 AS part"), str(tmp_path / "t"), "id")
    answers = iter(['Try this: {"where": "part = 1", "rationale": "a part"}', '{"stop": true}'])
    seen = []
    trials = loop.Loop(d, lambda view, name: len(view), loop.asked(lambda p: seen.append(p) or next(answers)), columns=["part"], prefix="a").run()
    assert [(t.where, t.score, t.rationale) for t in trials] == [("part = 1", 10.0, "a part")] and "repeat no filter" in seen[0]
    server = loop.serve(loop.grid(["part > 1", "part > 5"]))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    trials = loop.Loop(d, lambda view, name: {"score": len(view)}, loop.posted(f"http://127.0.0.1:{server.server_address[1]}"), columns=["part"], prefix="b").run()
    server.shutdown()
    assert [(t.where, t.score) for t in trials] == [("part > 1", 20.0), ("part > 5", None)]


def test_distribution(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, float("nan")), (4, None), (5, 2.0)], "id long, x double")
    assert measure.distribution(df, "x", (0.5,)).first().p50 == 1.0
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, v array<double>")
    pairs = measure.random_pairs(v, "id", "v", 3)
    assert pairs.count() == 3 and pairs.where(F.col("id") == F.col("other")).count() == 0


def test_block_pairs(spark):
    """Every two rows of a group meet once, whatever the size of blocks."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((23, 3))
    groups = [i % 2 for i in range(23)]
    df = spark.createDataFrame([(g, i, i // 2 + 1, [float(v) for v in x[i]]) for i, g in enumerate(groups)], "group int, key long, rank int, v array<double>")

    def products(later, earlier, same):
        s = later[2] @ earlier[2].T
        a, b = np.nonzero(later[1][:, None] > earlier[1][None, :])
        return pa.table({"a": later[0].take(pa.array(a)), "b": earlier[0].take(pa.array(b)), "s": pa.array(s[a, b])})

    got = sorted((r.a, r.b, round(r.s, 9)) for r in block_pairs(df, products, "a long, b long, s double", size=4).collect())
    assert got == sorted((i, j, round(float(x[i] @ x[j]), 9)) for i in range(23) for j in range(i) if groups[i] == groups[j])


def test_tokenize_file():
    """By the faster library where it splits alike, by the tokenizer elsewhere: the same ids."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    file = public.path("byte_bpe_50k.json")
    texts = ["It's 12 plain  words,\n\tété.", "日本語 and   emoji 🙂", "", None, "x" * 300]
    made = sig.tokenize("text", file)
    whole = tokenizers.Tokenizer.from_file(file)
    assert made(pa.array(texts)).to_pylist() == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert made._model.fast is not None  # the slow way for all texts was too slow
    assert sig.tokenize("text", file, max_length=2)(pa.array(texts)).to_pylist() == [whole.encode(t or "", add_special_tokens=False).ids[:2] for t in texts]
    assert sig.tokenize("text")(pa.array(["a  b a", None])).to_pylist()[1] == []


def test_slices_by_bytes(spark, monkeypatch):
    """Python meets about a megabyte of texts at a time, however many rows a batch has."""
    texts = pa.array(["ab " * 200_000, None, "", *["w%d x" % i * 20_000 for i in range(40)], "one two"])
    met = []

    class Sizes(sig.Signal):
        dtype = "int32"

        def compute(self, part):
            met.append((len(part), part.nbytes))
            return [len(t or "") for t in part.to_pylist()]

    assert Sizes("t")(texts).to_pylist() == [len(t or "") for t in texts.to_pylist()]
    assert sum(n for n, _ in met) == len(texts) and max(size for _, size in met) <= 1 << 20
    held = []
    flags = GramBank.flags
    monkeypatch.setattr(GramBank, "flags", lambda self, part: held.append(sum(len(t or "") for t in part)) or flags(self, part))
    assert bank_flags(texts, ("one two",), 2).to_pylist() == [x for t in texts.to_pylist() for x in flags(GramBank(["one two"], 2), [t])]
    assert max(held) <= 1 << 20
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame([(1, "one two")], "id long, t string")
    for made in (lambda: sig.tokenize("t").column(), lambda: select.contaminated(df, "t", df, "t", "id", 2)):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        made()
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)
