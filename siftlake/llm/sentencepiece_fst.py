"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three machines. The normaliser is a transducer
from characters to characters: its charsmap (a trie whose leaves hold outputs), and
a state that says whether a space came last, for the prefix, spare spaces and the
escape of spaces. The lexicon is an acceptor of pieces with their weights. Byte
fallback writes a character without a piece as bytes. Composed with an input,
these span a lattice whose arcs are pieces; the shortest path from its start to
its end in the tropical semiring (weights are added along a path, the least of
paths is kept) is the encoding. One best-first search serves both kinds of models:

* Unigram models weigh an arc by the piece's negative log probability.
* BPE models have no weights of pieces that would add up. A sequence is what the
  merges give if and only if each two neighbours are what the merges give for
  their join alone. So an arc weighs 0 if the merges keep it apart from the arc
  before it, and infinity otherwise. States remember the last piece; as a prefix
  has one encoding, at most one state at each place is within reach.

Where no piece crosses from a word to the escaped space that follows, the lattice
falls apart there, and each distinct word is solved once per worker and remembered
within a bound. Defined results: null and empty text encode to no ids; an id that
the model lacks decodes to nothing, and null ids to null; rows that repeat a
doc_id are encoded each.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftlake.llm.common import bound_batches

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
INFINITY = float("inf")


class Normaliser:
    """Characters to characters: what the model's specification says, as a transducer.

    Its states are whether a space came last. ``step`` is its transition: the
    longest string of the charsmap at a place, or the character itself.
    """

    def __init__(self, spec, fixed: list[str]):
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else " "
        self.units: tuple[int, ...] = ()
        self.outputs = b""
        if blob := spec.precompiled_charsmap:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.outputs = blob[4 + size :]
        self.fixed = sorted(fixed, key=len, reverse=True)  # symbols of the user's own are left as they are
        self.plain = not self.units and not self.squeeze and not self.fixed
        self.known: dict[str, tuple[int, str]] = {}  # transitions that one character decides

    def step(self, text: str, at: int) -> tuple[str, int]:
        """(output, characters read) at a place."""
        for p in self.fixed:
            if text.startswith(p, at):
                return p, len(p)
        if self.units:
            units, node, read, found = self.units, 0, 0, None
            node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
            for i in range(at, min(len(text), at + 32)):
                alive = True
                for byte in text[i].encode():
                    node ^= byte
                    unit = units[node] if node < len(units) else 0
                    if unit & 0x800000FF != byte:
                        alive = False
                        break
                    node ^= (unit >> 10) << ((unit & 512) >> 6)
                    leaf = units[node] & 0x7FFFFFFF if unit >> 8 & 1 else None
                if not alive:
                    break
                read += 1
                if leaf is not None:
                    found = leaf, read
            if found:
                value = self.outputs[found[0] : self.outputs.index(b"\0", found[0])]
                return value.decode(), found[1]
        return text[at], 1

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return ((self.space if self.prefix else "") + text.replace(" ", self.space)).replace(" ", self.space)
        out, at, spaced, begun = [], 0, self.squeeze, False
        while at < len(text):
            made, read = self.step(text, at)
            at += read
            if spaced:
                made = made.lstrip(" ")
            if made:
                if not begun and self.prefix:
                    out.append(self.space)
                begun = True
                out.append(made.replace(" ", self.space))
                spaced = made.endswith(" ")
            elif not begun and not self.squeeze and self.prefix:
                out.append(self.space)
                begun = True
            if not self.squeeze:
                spaced = False
        whole = "".join(out)
        if self.squeeze:
            while whole.endswith(self.space):
                whole = whole[: -len(self.space)]
        return whole


class Transducer:
    LIMIT = 500_000  # words remembered
    PAIRS = 1_000_000  # decisions on neighbours remembered

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, self.bpe = model.normalizer_spec, model.trainer_spec.model_type == 2
        kind = pb.ModelProto.SentencePiece.Type
        fixed = [p.piece for p in model.pieces if p.type == kind.USER_DEFINED]
        if model.trainer_spec.model_type not in (1, 2) or model.trainer_spec.treat_whitespace_as_suffix or (self.bpe and fixed):
            raise ValueError("compiled are unigram models, and BPE models without symbols of the user's own; spaces stand before words")
        self.normalise = Normaliser(spec, fixed)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte, self.unknown, self.shown = [-1] * 256, 0, {}
        normal = [p.score for p in model.pieces if p.type == kind.NORMAL]
        for i, p in enumerate(model.pieces):
            if p.type in (kind.NORMAL, kind.USER_DEFINED):
                # a symbol of the user's own is always worth taking
                self.ids[p.piece], self.score[p.piece] = i, p.score if p.type == kind.NORMAL else len(p.piece.encode()) * max(0.0, *normal) - 0.1
                self.shown[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kind.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                self.shown[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.UNKNOWN:
                self.unknown, self.shown[i] = i, " ⁇ ".encode()
        self.fallback = min(self.byte) >= 0
        self.lexicon: dict = {}  # the pieces as an acceptor: by character; under "" the piece that ends here
        for p in self.ids:
            node = self.lexicon
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.apart = all(_WORD.fullmatch(p) for p in self.ids)
        self.lowest = min(normal) - 10  # of a character without a piece
        self.raised = max(0.0, *(x / len(p) for p, x in self.score.items()))
        # when a piece is made, and the two that the merges make it of; a character is there from the start
        soonest = int(-max(self.score.values()))
        self.time = {p: 0 if len(p) == 1 else int(-x) + 1 - soonest for p, x in self.score.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        self.packed = {p: np.array([i], "<u4").tobytes() for p, i in self.ids.items()}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.decided = 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by its merges, best first and from the left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def half(self, piece: str, right: bool) -> str:
        """The left or right of the two pieces that the merges make ``piece`` of."""
        got = self.halves.get(piece)
        if got is None:
            parts, score = list(piece), self.score
            while len(parts) > 2:
                best, at = -INFINITY, 0
                for i in range(len(parts) - 1):
                    s = score.get(parts[i] + parts[i + 1])
                    if s is not None and s > best:
                        best, at = s, i
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            got = self.halves[piece] = (parts[0], parts[1])
        return got[right]

    def keeps(self, before: str, piece: str) -> bool:
        """Whether the merges leave both as they are when they stand side by side.

        Both are taken apart from the last merge back; a piece across the border
        that would have been made sooner than what stands there says no.
        """
        time, limit = self.time, INFINITY
        while True:
            across = time.get(before + piece)
            if across is not None and across < limit:
                return False
            left, right = time.get(before, 0), time.get(piece, 0)
            if left > right:
                limit, before = left, self.half(before, True)
            elif right:
                limit, piece = right + 1, self.half(piece, False)
            else:
                return True

    def apart_after(self, before: str, piece: str) -> bool:
        known = self.pairs.get(before)
        if known is None:
            known = self.pairs[before] = {}
        ok = known.get(piece)
        if ok is None:
            if self.decided >= self.PAIRS:
                self.pairs.clear()
                self.decided, known = 0, self.pairs.setdefault(before, {})
            ok = known[piece] = self.keeps(before, piece) if before else self.merged(piece) == [piece]
            self.decided += 1
        return ok

    def arcs(self, text: str, at: int) -> list[str]:
        """The composition's arcs from a place, shortest first; a character without a piece is one by itself."""
        out, node, i, n = [], self.lexicon, at, len(text)
        while i < n and (node := node.get(text[i])) is not None:
            i += 1
            if "" in node:
                out.append(node[""])
        if not out or len(out[0]) > 1:
            out.insert(0, text[at])
        return out

    def shortest(self, text: str) -> list[str]:
        """The shortest path through the lattice, by best-first search.

        Of the places within reach the one of least weight is settled next, of equal
        ones the furthest; its arcs are weighed one at a time, longest first. Places
        of the weight at hand wait on a stack, others in a heap.
        """
        n, bpe, pairs = len(text), self.bpe, self.pairs
        came: list[tuple[int, str] | None] = [None] * (n + 1)
        came[0] = (-1, "")
        here, heap, stack = 0.0, [], [(0, "", self.arcs(text, 0))]
        while came[n] is None:
            if not stack:
                here, to, at, piece = heapq.heappop(heap)
                if came[to] is None:
                    came[to] = at, piece
                    if to < n:
                        stack.append((to, piece, self.arcs(text, to)))
                continue
            at, before, arcs = stack[-1]
            if bpe:
                known = pairs.get(before)
                while arcs:
                    piece = arcs.pop()
                    to = at + len(piece)
                    if came[to] is None:
                        ok = known.get(piece) if known is not None else None
                        if ok or ok is None and self.apart_after(before, piece):
                            came[to] = at, piece
                            if to < n:
                                stack.append((to, piece, self.arcs(text, to)))
                            break
                else:
                    stack.pop()
            else:
                for piece in arcs:
                    heapq.heappush(heap, (here + self.weight(piece), at + len(piece), at, piece))
                stack.pop()
        out, at = [], n
        while at:
            at, piece = came[at]
            out.append(piece)
        return out[::-1]

    def weight(self, piece: str) -> float:
        """Of a piece of a unigram model; all are raised by a constant for each character, so that none is negative."""
        return self.raised * len(piece) - self.score.get(piece, self.lowest)

    def word_ids(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed.get(p) or self.spelt(p) for p in self.shortest(word)])

    def spelt(self, character: str) -> bytes:
        """A character without a piece: its bytes, or the unknown piece."""
        return np.array([self.byte[b] for b in character.encode()] if self.fallback else [self.unknown], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        text = self.normalise(text)
        if not text:
            return b""
        if not self.apart:
            return self.joined(self.word_ids(text))
        words, known = _WORD.findall(text), self.words
        try:
            return self.joined(b"".join(map(known.__getitem__, words)))
        except KeyError:
            if len(known) > self.LIMIT:
                known.clear()
            long = {}
            for w in words:
                if w not in known and w not in long:
                    (known if len(w) <= 64 else long)[w] = self.word_ids(w)
            return self.joined(b"".join(known[w] if w in known else long[w] for w in words))

    def joined(self, ids: bytes) -> bytes:
        """Without byte fallback, a run of unknown characters is one unknown piece."""
        if self.fallback:
            return ids
        x = np.frombuffer(ids, "<u4")
        return x[np.concatenate([[True], (x[1:] != self.unknown) | (x[:-1] != self.unknown)])].tobytes()

    def decode(self, ids: bytes | np.ndarray) -> str:
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        text = b"".join(map(self.shown.get, ids.tolist(), [b""] * len(ids))) if len(ids) else b""
        text = text.decode("utf-8", "replace")
        if self.squeeze:
            return text.lstrip(" ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.cache
def transducer(path: str) -> Transducer:
    """Compiled once in a worker; its words stay known from task to task."""
    return Transducer(path)


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of each text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            ids = [np.frombuffer(t.encode(x or ""), "<u4").astype(np.int32) for x in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of each list of ids."""
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            texts = [None if x is None else t.decode(np.array([i for i in x if i is not None], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip) of each text, encoded and decoded.

    ``round_trip`` says whether the text came back, as the model normalises it; a
    text that holds the escape character itself comes back with spaces there.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            rows = []
            for k, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = t.encode(text or "")
                back = t.decode(ids)
                rows.append((k, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == (text or "").replace(SPACE, " ")))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.record_batch([pa.array(c, x) for c, x in zip(zip(*rows) if rows else [()] * 5, types)], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
