"""Signals: functions of columns that make one new column.

A signal with ``to_column`` is a Spark expression. Any other has ``compute`` over
Arrow arrays and runs as an iterator Arrow UDF: ``setup`` once in a task, then
slices of at most ``batch_size`` rows and about a megabyte, cast to ``dtype``.
"""

from __future__ import annotations

import importlib
import inspect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import DataType

from siftlake.functions import grouped, text, vectors
from siftlake.functions.tokens import encoder


def arrow_type(kind: str | pa.DataType) -> pa.DataType:
    return pa.type_for_alias(kind) if isinstance(kind, str) else kind


def matrix(a: pa.Array) -> np.ndarray:
    """Lists of one length as a float32 matrix; numbers as one column."""
    if pa.types.is_list(a.type) or pa.types.is_fixed_size_list(a.type):
        return np.array(a.to_pylist(), np.float32).reshape(len(a), -1)
    return np.asarray(a.to_numpy(zero_copy_only=False), np.float32)[:, None]


def vector_rows(x: np.ndarray) -> pa.Array:
    """A matrix as lists of float32."""
    x = np.ascontiguousarray(x, np.float32)
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1], x.ravel())


class Signal:
    dtype: str | pa.DataType = "float32"
    gpu = False
    batch_size = 1024

    def __init__(self, *inputs: str):
        self.inputs = list(inputs)

    def setup(self) -> None:
        """Once in a task, before its first rows."""

    def compute(self, *arrays: pa.Array):
        raise NotImplementedError

    def to_column(self) -> Column | None:
        """The signal as an expression, if it is one."""
        return None

    @property
    def spark_type(self) -> DataType:
        return from_arrow_type(arrow_type(self.dtype))

    def describe(self) -> dict:
        """What a recipe keeps of it: its name, its inputs and its plain settings."""
        out: dict = {"signal": type(self).__name__, "inputs": self.inputs}
        for name in sorted(set(vars(self)) - {"inputs"}):
            value = getattr(self, name)
            if name[0] != "_" and isinstance(value, (str, int, float)):
                out[name] = value
        return out

    def __call__(self, *arrays) -> pa.Array:
        arrays = [pa.array(a) if not isinstance(a, (pa.Array, pa.ChunkedArray)) else a for a in arrays]
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        if not getattr(self, "_ready", False):
            self.setup()
            self._ready = True
        kind, parts = arrow_type(self.dtype), []
        for part in text.slices(arrays, self.batch_size):
            out = self.compute(*part)
            out = out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out if isinstance(out, pa.Array) else pa.array(out)
            parts.append(out if out.type == kind else out.cast(kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    def column(self) -> Column:
        native = self.to_column()
        if native is not None:
            return native.cast(self.spark_type)
        if session := SparkSession.getActiveSession():
            text.bound_batches(session)
        sig = self

        if len(self.inputs) == 1:

            def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for a in batches:
                    yield sig(a)

            run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        else:

            def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                for arrays in batches:
                    yield sig(*arrays)

            run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, self.spark_type)(*self.inputs)


class GroupSignal(Signal):
    """A scalar for each group, given to all its rows; ``compute`` gets a group in its order."""

    def over(self, window) -> Column | None:
        """The signal as a window expression, if it is one."""
        return None

    def value(self, *arrays: pa.Array):
        if not getattr(self, "_ready", False):
            self.setup()
            self._ready = True
        return pa.scalar(self.compute(*arrays)).cast(arrow_type(self.dtype)).as_py()


def signal(dtype: str | pa.DataType = "float32", *, inputs: list[str] | None = None, group: bool = False, batch_size: int = 1024) -> Callable:
    """Make a function of Arrow arrays a signal; its inputs default to its argument names."""

    def wrap(f: Callable) -> Callable[..., Signal]:
        names = inputs or list(inspect.signature(f).parameters)
        base = GroupSignal if group else Signal
        made = type(f.__name__, (base,), {"dtype": dtype, "batch_size": batch_size, "compute": lambda self, *a: f(*a), "__doc__": f.__doc__})
        return lambda *own: made(*(own or names))

    return wrap


class _Native(Signal):
    def __init__(self, name: str, dtype: str | pa.DataType, inputs: list[str], build: Callable[[], Column], **params):
        super().__init__(*inputs)
        self._name, self.dtype, self._build = name, dtype, build
        for k, v in params.items():
            setattr(self, k, v)

    def to_column(self) -> Column:
        return self._build()

    def describe(self) -> dict:
        return super().describe() | {"signal": self._name}


def length(column: str) -> Signal:
    return _Native("length", "int32", [column], lambda: text.length(F.col(column)))


def n_chars(column: str) -> Signal:
    return _Native("n_chars", "int32", [column], lambda: text.n_chars(F.col(column)))


def load_model(model: str | Callable | None) -> Callable | None:
    """A model for a signal: a callable, or "module:name" of one; called without arguments if it is a class."""
    if isinstance(model, str):
        module, name = model.split(":")
        model = getattr(importlib.import_module(module), name)
    return model() if inspect.isclass(model) else model


class _Model(Signal):
    """A signal by a model of the caller's, loaded once in a task; it takes a list of texts."""

    def __init__(self, column: str, model: str | Callable):
        super().__init__(column)
        self._model = model
        self.model = model if isinstance(model, str) else getattr(model, "__name__", type(model).__name__)

    def setup(self) -> None:
        self._call = load_model(self._model)


class _LanguageModel(_Model):
    """The model gives (code, confidence) of each text's first 2,000 characters, blanks collapsed."""

    dtype = "string"

    def __init__(self, column: str, model: str | Callable, min_confidence: float):
        super().__init__(column, model)
        self.min_confidence = min_confidence

    def describe(self) -> dict:
        return super().describe() | {"signal": "language"}

    def compute(self, texts: pa.Array) -> list[str | None]:
        heads = [None if t is None else " ".join(t.split())[:2000] for t in texts.to_pylist()]
        found = iter(self._call([h for h in heads if h is not None]))
        return [None if h is None else code if p >= self.min_confidence else "und" for h in heads for code, p in [next(found) if h is not None else ("", 0.0)]]


def language(column: str, min_confidence: float = 0.5, model: str | Callable | None = None) -> Signal:
    """By a model of the caller's, else by stop words."""
    if model is not None:
        return _LanguageModel(column, model, min_confidence)
    return _Native("language", "string", [column], lambda: text.language(F.col(column), min_confidence), min_confidence=min_confidence)


def hash_part(column: str, parts: int) -> Signal:
    return _Native("hash_part", "int64", [column], lambda: text.hash_part(F.col(column), parts), parts=parts)


def is_val(column: str, parts: int = 50) -> Signal:
    return _Native("is_val", "bool", [column], lambda: text.is_val(F.col(column), parts), parts=parts)


class contaminated(Signal):
    """Shares a word n-gram with the strings of ``against``; null for null."""

    dtype = "bool"

    def __init__(self, column: str, against: list[str], ngram: int = 13):
        super().__init__(column)
        self._bank, self.ngram = tuple(sorted(set(against))), ngram

    def compute(self, texts: pa.Array) -> pa.Array:
        return text.bank_flags(texts, self._bank, self.ngram)


def resolution(width: str, height: str) -> Signal:
    return _Native("resolution", "int32", [width, height], lambda: vectors.resolution(F.col(width), F.col(height)))


def aesthetic(embedding: str, weights: list[float], bias: float) -> Signal:
    return _Native("aesthetic", "float32", [embedding], lambda: vectors.aesthetic(F.col(embedding), weights, bias), bias=bias)


def clip_score(image: str, caption: str) -> Signal:
    return _Native("clip_score", "float32", [image, caption], lambda: vectors.clip_score(F.col(image), F.col(caption)))


class quality(Signal):
    """A model of the caller's (texts to numbers); without one a stand-in: share of distinct words, letters and clean words, 0 to 5."""

    def __init__(self, column: str, model: str | Callable | None = None):
        super().__init__(column)
        self._model = model
        self.model = model if isinstance(model, str) else getattr(model, "__name__", "words")

    def setup(self) -> None:
        self._call = load_model(self._model)

    def compute(self, texts: pa.Array) -> np.ndarray:
        if self._call:
            return np.asarray(self._call([t or "" for t in texts.to_pylist()]), np.float32)
        out = []
        for t in texts.to_pylist():
            w = (t or "").split()
            if not w:
                out.append(0.0)
                continue
            clean = sum(x.strip(".,;:!?").isalpha() and not x.isupper() for x in w) / len(w)
            out.append(5 * clean * min(1.0, 2 * len(set(w)) / len(w)))
        return np.array(out, np.float32)


class embed(Signal):
    """A model of the caller's (texts to a matrix), made unit length; without one a stand-in: hashed word counts."""

    dtype = pa.list_(pa.float32())

    def __init__(self, column: str, dim: int = 384, model: str | Callable | None = None):
        super().__init__(column)
        self.dim, self._model = dim, model
        self.model = model if isinstance(model, str) else getattr(model, "__name__", "words")

    def setup(self) -> None:
        self._call = load_model(self._model)

    def compute(self, texts: pa.Array) -> pa.Array:
        values = [t or "" for t in texts.to_pylist()]
        if self._call:
            x = np.asarray(self._call(values), np.float32).reshape(len(values), -1)
        else:
            x = np.zeros((len(values), self.dim), np.float32)
            for i, t in enumerate(values):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    x[i, h % self.dim] += 1 if h >> 31 else -1
        return vector_rows(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))


class tokenize(Signal):
    """Ids from a tokenizer file, or hashed words without one; cut to ``max_length`` if given."""

    dtype = pa.list_(pa.int32())

    def __init__(self, column: str, tokenizer: str = "", max_length: int = 0):
        super().__init__(column)
        self.tokenizer, self.max_length = tokenizer, max_length

    def setup(self) -> None:
        self._model = encoder(self.tokenizer) if self.tokenizer else None

    def _ids(self, value: str) -> np.ndarray:
        if self._model:
            return np.frombuffer(self._model.encode(value), "<i4")
        return np.array([zlib.crc32(w.encode()) & 0x7FFF for w in value.split()], np.int32)

    def compute(self, texts: pa.Array) -> pa.Array:
        ids = [self._ids(t or "")[: self.max_length or None] for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))


class frames_signal(Signal):
    """A signal of a column of frames (lists of rows of RGB), such as motion or scene cuts."""

    def __init__(self, column: str, kind: str = "motion", threshold: float = 0.5):
        super().__init__(column)
        self.kind, self.threshold = kind, threshold
        self.dtype = "float32" if kind == "motion" else "int32"

    def compute(self, clips: pa.Array) -> pa.Array:
        from siftlake.functions.media import motion_of, scene_cuts_of

        f = motion_of if self.kind == "motion" else lambda x: scene_cuts_of(x, self.threshold)
        return pa.array([None if c is None else f(np.array(c)) for c in clips.to_pylist()], arrow_type(self.dtype))


class Group:
    """Built-in group signals; ``plan`` adds them to a frame of rows."""

    def __init__(self, kind: str, column: str | None = None, eps: float = 1e-3):
        self.kind, self.column, self.eps = kind, column, eps

    def describe(self) -> dict:
        return {"signal": f"group.{self.kind}", "inputs": [self.column] if self.column else []} | ({"eps": self.eps} if self.kind == "idle_fraction" else {})

    def plan(self, df, key: str, order, name: str):
        if self.kind == "length":
            return df.withColumn(name, grouped.length(key))
        if self.kind in ("success", "peak"):
            return df.withColumn(name, getattr(grouped, self.kind)(key, self.column))
        made = grouped.steps(df, key, order, self.column, "_s_")
        value = {"jerk": lambda: grouped.jerk(key, "_s_"), "idle_fraction": lambda: grouped.idle_fraction(key, self.eps, "_s_"), "path_length": lambda: grouped.path_length(key, "_s_")}[self.kind]()
        return made.withColumn(name, value).drop("_s_d1", "_s_d2")
