"""Every operator against a slow version of itself, on texts with the edges in them."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftlake.llm import gif, license_scan, quality
from siftlake.llm.common import Scratch, components
from siftlake.llm.grid_join import near_vectors
from siftlake.llm.line_dedup import dedup_lines
from siftlake.llm.minhash import drop_near_duplicates, near_duplicates
from siftlake.llm.packing import Encoder, _split_is_known, pack, plan
from siftlake.llm.quality import keep_quality, score_quality
from siftlake.llm.sentencepiece_fst import Transducer, decode_ids, encode_texts, round_trip
from siftlake.llm.suffix_dedup import BLOCK, drop_repeats, repeated, suffix_order
from siftlake.llm.toxicity import Features, score_toxicity, swap_products, swaps, word_features
from tests.llm import brute

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# names that the operators use inside, on columns of the caller's own
CLASH = "doc_id long, text string, k long, hot string, first int, _k int, h1 int, id int, own int, kept int, n int"


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "or", "é", "ti", "on"]) for _ in range(rng.randint(1, 4)))
    text = lambda m: " ".join(word() for _ in range(m))
    base, line = text(60), "A line that many documents share."
    docs = [base, base, "", None, "x", " \t ", "a b", "a b", "MIT License  mit license", "The GNU General Public License.", "ab" * 150, "z" * 400, text(3000)]
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        docs.append(rng.choice([" ".join(w), text(rng.randint(1, 80)), f"{line}\n{text(30)}\n{line.upper()}", text(20) + base[30:200] + text(20)]))
    return list(enumerate(docs))


def frame(spark, docs, schema=CLASH):
    extra = schema.count(",") - 1
    return spark.createDataFrame([(k, t, *[None] * extra) for k, t in docs], schema).repartition(3)


@pytest.fixture(scope="module")
def docs():
    return corpus()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5)]
    want = brute.components({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    assert dict(components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()) == want
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, docs):
    for words in (4, 5):
        want = brute.near_duplicates(docs, words, 80)
        got = {r.doc_id: r for r in near_duplicates(frame(spark, docs), words, piece=2000).collect()}
        assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
        assert all(r.kept == (k == r.component_id) for k, r in got.items())
    df = frame(spark, [*docs, (0, docs[0][1]), (None, docs[0][1])])
    rows = near_duplicates(df).collect()
    assert sum(r.doc_id == 0 for r in rows) == 2 and next(r for r in rows if r.doc_id is None).component_id is None
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sum(r.doc_id == 0 for r in kept.collect()) == 2 and kept.where("doc_id = 1").count() == 0
    assert near_duplicates(df.limit(0)).count() == 0
    # an id that names two texts ties them
    a, b = docs[0][1], docs[12][1]
    tied = near_duplicates(frame(spark, [(3, a), (5, a), (5, b), (7, b), (8, "")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in tied) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True)]


def test_lines(spark, docs):
    owner = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for k, t in docs:
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), k)
    want = {k: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or owner[key(x)] == k) for k, t in docs}
    got = {r.doc_id: r for r in dedup_lines(frame(spark, docs), batches=5, fanout=2, digest=True).collect()}
    assert {k: r.kept_sha256 for k, r in got.items()} == {k: sha(t.encode()) for k, t in want.items()}
    assert all(r.n_lines == (docs[k][1] or "").count("\n") + 1 for k, r in got.items())
    df = frame(spark, docs)
    out = dedup_lines(df)
    assert out.columns == df.columns and {r.doc_id: r.text or "" for r in out.collect()} == want
    assert dedup_lines(df.limit(0), digest=True).count() == 0
    twice = dedup_lines(frame(spark, [(7, "a line of words"), (7, "a line of words"), (None, "a line of words"), (8, None)]), digest=True).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in twice) == [(0, 0), (7, 1), (7, 1), (8, 0)]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n, a = rng.randint(1, 90), rng.choice([1, 2, 3, 255])
        x = [rng.randint(0, a) for _ in range(n)]
        x = np.array(x[: max(1, n // 6)] * 6 if rng.random() < 0.3 else x, np.uint8)
        b = x.tobytes()
        assert suffix_order(x, 1000)[0].tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    x = np.frombuffer(b"abcdefgh" * 5, np.uint8)
    valid = np.arange(40) <= 28
    assert repeated(x, valid, 12).tolist() == list(range(8, 29))


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_repeats(spark, docs, chunk):
    want = brute.repeats(docs, 100)
    df = frame(spark, docs)
    got = {r.doc_id: r for r in drop_repeats(df, chunk=chunk, digest=True).collect()}
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == {k: (*v[:3], sha(v[3])) for k, v in want.items()}
    assert sum(v[1] for v in want.values()) > 1000
    out = drop_repeats(df, chunk=chunk)
    assert out.columns == df.columns and {r.doc_id: r.text or "" for r in out.collect()} == {k: v[3].decode("utf-8", "ignore") for k, v in want.items()}
    assert drop_repeats(df.limit(0), digest=True).count() == 0


def test_repeats_of_one_id(spark):
    """Rows of one id with different texts, equal rows, and rows without an id."""
    a, b = "q" * 50 + "".join(map(chr, range(40, 120))) * 2, "".join(map(chr, range(120, 40, -1))) * 2
    rows = [(1, a), (1, a), (2, a), (3, b), (3, f"{b} and {a}"), (None, b), (None, b), (None, None), (4, "short")]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in drop_repeats(frame(spark, rows), digest=True).collect())
    of = lambda k: [x[1:] for x in got if x[0] == k]
    assert of(1) == [(210, 0)] * 2 and of(2) == [(210, 210)] and of(4) == [(5, 0)]
    assert of(3) == [(160, 160), (375, 370)] and of(0) == [(0, 0), (160, 0), (160, 0)]


def test_repeats_in_long_texts(spark):
    """Over the block that is hashed at once, with repeats across its border and one name in many different places."""
    rng = random.Random(8)
    noise = lambda m: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(m))
    long, mark = noise(BLOCK + 40_000), "one phrase of twenty-four letters or more"
    rows = [(1, long), (2, noise(100) + long[BLOCK - 5000 : BLOCK + 5000] + noise(100)), (3, "".join(noise(rng.randint(60, 90)) + mark for _ in range(150))), (4, "".join(noise(rng.randint(60, 90)) + mark for _ in range(150)))]
    rows.append((5, rows[2][1][3000:6000] + rows[3][1][500:900]))
    want = brute.repeats(rows, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in drop_repeats(frame(spark, rows), chunk=2000, digest=True).collect()}
    assert got == {k: (*v[:3], sha(v[3])) for k, v in want.items()} and want[2][1] >= 10_000 and want[5][1] > 3000


def test_licenses(spark, docs):
    got = {r.doc_id: r for r in license_scan.scan(frame(spark, docs)).collect()}
    want = {k: brute.licenses(t, license_scan.PHRASES) for k, t in docs}
    assert {k: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for k, r in got.items()} == want
    moved = license_scan.TEMPLATES[0][1].replace("free of charge ", "").replace("copy", "a copy", 1)
    rows = license_scan.scan(frame(spark, [(1, moved), (1, None), (2, "licensed under CC-BY-NC 4.0, and more"), (None, "mit")])).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in rows) == [(0, ""), (1, ""), (1, "mit"), (2, "cc-by-nc")] and all(0 <= r.score <= 1 for r in rows)
    assert license_scan.scan(frame(spark, docs).limit(0)).count() == 0


def test_packing(spark, docs):
    enc = Encoder(BPE)
    assert enc.fast and not _split_is_known({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "Whitespace"}})
    for _, t in [*docs, (0, "a  b\n\n c  "), (0, "<|endoftext|> x"), (0, "日本 é\x1c 　x"), (0, "it's we'll 12ab")]:
        assert enc.encode(t or "") == enc.whole(t or "")
    rows = pack(frame(spark, docs), BPE, capacity=64).collect()
    ids = {k: enc.whole(t or "") + np.array([2], "<u4").tobytes() for k, t in docs}
    got, bins = {}, {}
    for r in rows:
        part = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length and (r.length == 64 or r.piece == 0)
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, parts in got.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == len(ids[k]) // 4 and all(a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert set(got) == set(ids) and len(bins) <= 1.05 * sum(len(v) for v in ids.values()) / 256 + 3
    assert pack(frame(spark, docs).limit(0), BPE).count() == 0 and plan({}, 1024) == []


def test_plan_is_optimal_for_large():
    for seed in range(20):
        rng = random.Random(seed)
        items = [rng.randint(342, 1024) for _ in range(rng.randint(1, 40))]
        used = 1 + max(f + m - 1 for _, _, m, f, _ in plan({n: items.count(n) for n in items}, 1024))
        left, best = sorted(items), 0  # the largest with the smallest, if they fit
        while left:
            n = left.pop()
            if left and left[0] + n <= 1024:
                left.pop(0)
            best += 1
        assert used == best


def test_sentencepiece(spark, docs):
    import sentencepiece

    model, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), Transducer(PIECES)
    rng = random.Random(3)
    texts = [x or "" for _, x in docs] + ["".join(rng.choice("aeinrstlo mth\n") for _ in range(rng.randint(1, 30))) for _ in range(2000)] + ["  a  b ", "日本語 \U0001f600é", "a" * 300]
    for x in texts:
        assert np.frombuffer(t.encode(x), "<u4").tolist() == model.encode(x) and t.decode(t.encode(x)) == x
    assert all(t.keeps(a, b) == (t.merged(a + b) == [a, b]) for a, b in [("▁the", "re"), ("▁th", "e"), ("ing", "s"), ("▁", "a"), ("in", "g")])
    df = frame(spark, docs)
    assert all(r.round_trip for r in round_trip(df, PIECES).collect())
    back = {r.doc_id: r.text for r in decode_ids(encode_texts(df, PIECES), PIECES).collect()}
    assert back == {k: x or "" for k, x in docs}


def _unigram(path, spec=None, fallback=True, own=()):
    """A unigram model written by hand: pieces of a few texts with weights by length."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    kind, m = pb.ModelProto.SentencePiece.Type, pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = 1, fallback, 0
    if spec is not None:
        m.normalizer_spec.CopyFrom(spec)
    else:
        m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    m.pieces.add(piece="<unk>", score=0, type=kind.UNKNOWN)
    for i in range(256 if fallback else 0):
        m.pieces.add(piece=f"<0x{i:02X}>", score=0, type=kind.BYTE)
    for p in own:
        m.pieces.add(piece=p, score=0, type=kind.USER_DEFINED)
    rng = random.Random(6)
    text = "▁the▁one▁on▁an▁other▁hand▁é▁stands▁still▁fi▁AB"
    for p in sorted({text[i : i + n] for n in (1, 2, 3, 4, 5) for i in range(len(text) - n + 1)} - {"h", *own}):
        if "▁" not in p[1:]:
            m.pieces.add(piece=p, score=-rng.uniform(2, 9) - (0 if len(p) == 1 else 1), type=kind.NORMAL)
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kind", ["identity", "nmt_nfkc", "nmt_nfkc_cf", "no fallback", "own"])
def test_unigram_model(tmp_path, kind):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = None
    if kind.startswith("nmt"):
        whole = pb.ModelProto()
        whole.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=kind).serialized_model_proto())
        spec = whole.normalizer_spec
        spec.remove_extra_whitespaces = spec.add_dummy_prefix = spec.escape_whitespaces = True
    path = _unigram(tmp_path / "u.model", spec, kind != "no fallback", ("<own>", "hand") if kind == "own" else ())
    model, t = sentencepiece.SentencePieceProcessor(model_file=path), Transducer(path)
    rng = random.Random(4)
    texts = ["", " ", "   ", "the one on another hand", "  the   one ", "é", "e\u0301 ﬁ Ａ①", "\u3000wide\u00a0space\u200b", "日本 \U0001f600", "x" * 70, "<own>hand the<own>", "\t\n tab"]
    texts += ["".join(rng.choice("theon adrsilféAB ﬁ\u0301zq") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    for x in texts:
        assert np.frombuffer(t.encode(x), "<u4").tolist() == model.encode(x), x
        assert t.decode(t.encode(x)) == model.decode(model.encode(x)), x


def test_gif(spark, docs):
    rng = random.Random(2)
    for n in (0, 1, 2, 300, 30000):
        for a in (1, 60, 255):
            d = bytes(rng.randint(0, a) for _ in range(n))
            assert gif.lzw_decode(gif.lzw_encode(d), 8, n + 9) == d
    rows = gif.store_and_read(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        p = gif.padded((docs[r.doc_id][1] or "").encode())
        assert r.payload_bytes == len(p) > 0 == len(p) % 64 and r.payload_sha256 == sha(p) and r.tail_crc32 == zlib.crc32(p[-64:])
        assert r.media_sha256 == sha(gif.store(p)) and r.media_bytes == len(gif.store(p))
    red, see = np.zeros((2, 4), np.uint8), np.array([[1, 2], [2, 1]], np.uint8)
    palette = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    data = gif.encode([{"indices": red, "delay": 5}, {"indices": see, "left": 1, "transparent": 2, "disposal": 3, "delay": 7}, {"indices": see, "disposal": 2}, {"indices": see[:1], "top": 1, "transparent": 1}], 4, 2, palette)
    f = list(gif.decode(data))
    assert [x["delay"] for x in f] == [5, 7, 10, 10] and f[1]["canvas"][0, 1].tolist() == [0, 255, 0, 255] and f[1]["canvas"][0, 2].tolist() == [255, 0, 0, 255]
    assert f[1]["canvas"][1, 2].tolist() == [0, 255, 0, 255] and f[2]["canvas"][1, 2].tolist() == [255, 0, 0, 255] and f[3]["canvas"][0, 0].tolist() == [0, 0, 0, 0] and f[3]["canvas"][1, 1].tolist() == [0, 0, 255, 255]
    media = spark.createDataFrame([(1, data), (2, None), (3, b"junk"), (4, data[:60])], "doc_id int, media binary")
    got = {r.doc_id: r.frames for r in gif.frames_of(media).collect()}
    assert [x.delay for x in got[1]] == [5, 7, 10, 10] and sum(got[1][0].histogram) == 8 and got[2] is None and got[3] is None and len(got[4]) < 4


def test_foreign_gif(spark):
    """Bytes that this encoder didn't write: a sample known from tutorials, a local palette, interlace, clear codes at will."""
    data = bytes.fromhex("474946383961 0A000A00910000 FFFFFF FF0000 0000FF 000000 21F9040000000000 2C000000000A000A0000 02168C2D99872A1CDC33A00275EC95FAA8DE608C04914C0100 3B")
    (f,) = gif.decode(data)
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert ["".join(map(str, r)) for r in f["indices"].tolist()] == rows and f["canvas"][0, 0].tolist() == [255, 0, 0, 255] and f["canvas"][9, 0].tolist() == [0, 0, 255, 255]
    # 3 x 9, interlaced, palette of its own (two colours), samples written as codes of three bits between clear codes
    x = np.arange(27).reshape(9, 3) % 2
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    codes = [c for v in x[order].ravel() for c in (4, int(v))] + [5]
    bits = "".join(format(c, "03b")[::-1] for c in codes)
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    data = b"GIF87a" + bytes([3, 0, 9, 0, 0, 0, 0]) + b"," + bytes([0, 0, 0, 0, 3, 0, 9, 0, 0xC0]) + bytes([9, 8, 7, 1, 2, 3]) + bytes([2, len(stream)]) + stream + b"\0;"
    (f,) = gif.decode(data)
    assert (f["indices"] == x).all() and f["canvas"][0, 0, :3].tolist() == [9, 8, 7] and f["canvas"][0, 1, :3].tolist() == [1, 2, 3]
    huge = b"GIF89a" + bytes([255] * 4) + bytes([0, 0, 0]) + b";"
    rng = random.Random(7)
    broken = []
    for _ in range(300):
        b = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(6, len(b))] = rng.randrange(256)
        broken.append(bytes(b[: rng.randint(10, len(b))]))
    rows = [(i, b, "mine") for i, b in enumerate([data, huge, *broken])]
    got = {r.doc_id: r for r in gif.frames_of(spark.createDataFrame(rows, "doc_id int, media binary, frames string")).collect()}
    assert len(got) == 302 and len(got[0].frames) == 1 and got[1].frames is None


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 8))
    v = [*base, *base[:10], *(base[:30] + 0.03 * rng.standard_normal((30, 8))), *(base[0] + 0.02 * rng.standard_normal((60, 8)))]
    rows = [(i, [float(x) for x in u], i % 3 if i < 80 else 0) for i, u in enumerate(v)]
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [1.0, None], 1), (504, rows[0][1], None), (505, [1.0, 2.0], 0), (506, [1.0, 2.0], 0), (507, [], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, id int, n int").repartition(5)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df, block=16 * 64, leaf=4).collect())
    dims = lambda d: brute.near_vectors([r for r in rows if r[1] and len(r[1]) == d], 0.98)
    want = sorted([*dims(8), *dims(2), (500, 0, 500), (507, 0, 507)])
    assert got == want and max(r[1] for r in got) > 40
    assert near_vectors(df.limit(0)).count() == 0
    # rows of one id are vectors of their own; labels may be large
    twice = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1.0, 0.02])]
    rows = near_vectors(spark.createDataFrame([(k, v, 2**40) for k, v in twice], "vec_id long, embedding array<float>, label long")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1)]


def labelled(spark, n=300):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ti", "on"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        w = [word() for _ in range(rng.randint(20, 120))]
        w = w if good else [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["gronk", "flurb", "gronkish"])
        elif rng.random() < 0.3:
            w[3:4] = ["the", "muslims", "and", "women", "."]
        rows.append((k, " ".join(w)))
        labels.append((k, int(good), int(toxic), None))
    labels += [(None, 1, 1, None), (3, None, None, None)]
    return frame(spark, [*rows, (n, None), (n + 1, ""), (None, "a b")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_classifiers(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.where("toxic IS NOT NULL").collect()}
    for f, name, folds, out in ((score_quality, "quality", 5, 0), (score_toxicity, "toxic", 4, 2)):
        rows = f(docs, labels).collect()
        assert len(rows) == 303 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id][name] for r in held) / len(held) > 0.95
        same = f(docs, labels.limit(0)).collect()
        assert len({r.score for r in same}) == 1 and f(docs.limit(0), labels).count() == 0
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and 150 < kept.count() < 303


def test_encode_is_of_one_text():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cd\nEé,. ") for _ in range(rng.choice([0, 1, 399, 400, 401, 900, 5000]))).encode() for _ in range(60)]
    x, counts = quality.encode(texts)
    parts = [quality.encode([t]) for t in texts]
    assert (np.concatenate([p[0] for p in parts]) == x).all() and (np.concatenate([p[1] for p in parts]) == counts).all()
    model = quality.GatedAttention(x.shape[1])
    y = np.array([i % 2 for i in range(60)], float)
    # the gradient against differences
    score, memory = model.forward(x, counts)
    loss = lambda: -np.log(np.where(y > 0, p := model.forward(x, counts)[0], 1 - p)).mean()  # noqa: E731, F841
    for name, g in model.gradient(y, score, memory).items():
        at = tuple(rng.randrange(n) for n in g.shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6
    model.fit(x, counts, y, epochs=1)
    scores = model.score(texts)
    assert (scores == [model.score([t])[0] for t in texts]).all() and (scores == model.score(texts[::-1])[::-1]).all()
    assert np.allclose(scores, model.forward(x, counts)[0])
    long = b"".join(texts) * 20  # over the part that is taken at once
    assert len(long) > 1 << 20 and np.isclose(model.score([long])[0], model.forward(*quality.encode([long]))[0][0])


def test_equal_texts_have_equal_scores(spark):
    docs, labels = labelled(spark)
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    one, other = ({(r.doc_id, r.score) for r in score_quality(docs.repartition(n), labels).collect()} for n in (2, 7))
    assert one == other and all((k + 1000, s) in one for k, s in one if k is not None and k < 1000)


def test_licenses_in_long_texts(spark):
    """Time grows with the length, not with its square; the letters A-Z alone are lowered."""
    rows = [(1, "MIT LICENSE " + "to the of and word " * 100_000 + "mit License"), (2, "m\u0130t license GENERAL PUBLIC LICENSE"), (3, "\u212aapache license")]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {1: (500_004, 2, 0, 500_002), 2: (5, 1, 2, 2), 3: (2, 0, None, None)}


def test_license_labels(spark):
    """Votes by diagonal against a slow count on texts made of templates with words put in, left out and changed."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        label, text = rng.choice(license_scan.TEMPLATES)
        w = text.split()
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = ["filler"] * rng.randint(0, 2)
        rows.append((k, "some words before " + " ".join(w) + " and after"))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {k: brute.license_labels(t, license_scan._votes(), 0.75, 3) for k, t in rows}


def test_groups_dont_decide(spark):
    docs, labels = labelled(spark)
    probe = frame(spark, [(10_000 + i, f"the {g} and the one on the other") for i, g in enumerate(["women", "men", "muslims", "jews"])])
    scores = [r.score for r in score_toxicity(docs.unionByName(probe), labels).where("doc_id >= 10000").collect()]
    assert max(scores) < 0.3 and max(scores) - min(scores) < 0.05


def test_all_swapped_sentences_count(spark):
    """The penalty is on every sentence that names a group, wherever in its text it stands."""
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(200):
        toxic = rng.random() < 0.4
        names = ["men"] * 12 + ["jews"] * 12 if toxic or rng.random() < 0.1 else []
        said = ["gronk" if toxic and rng.random() < 0.8 else "an" for _ in range(24)]
        sentences = [f"the {g} {w} on" for g, w in zip(names, said)] + ["the one or the other"]
        rows.append((k, sentences))
        labels.append((k, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = [(1000, "the men"), (1001, "the jews"), (1002, "the gronk")]
    forth, back = ([(k, ". ".join(s[::step])) for k, s in rows] + probe for step in (1, -1))
    one, other = ({r.doc_id: r.score for r in score_toxicity(frame(spark, t), labels).collect()} for t in (forth, back))
    assert one == other
    # the sum of products against one pair after the other
    texts = [". ".join(f"{rng.choice(['men', 'jews', 'gays'])} on {rng.choice(['women', 'the', 'muslims'])}" for _ in range(m)) for m in (3000, 0, 40)]
    chosen = sorted({f for w in ["men", "women", "jews", "muslims", "on"] for f in word_features(w)})
    known = Features({f: i for i, f in enumerate(chosen)})
    named = {i: k for k, i in enumerate(i for i, f in enumerate(chosen) if f != word_features("on")[0])}
    slow, n = np.zeros((len(named), len(named))), 0
    for a, b in (p for t in texts for p in swaps(t, known)):
        d = np.array([(i in a) - (i in b) for i in named], float)
        slow, n = slow + np.outer(d, d), n + 1
    fast, m = swap_products(texts, known, named)
    assert n == m > 4000 and (slow == fast).all() and fast.any()
