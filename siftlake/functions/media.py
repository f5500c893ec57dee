"""Image and video signals: sizes from headers, motion and cuts from frames.

Decoders and models are plug-ins; what they feed is here.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType


def header_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) of PNG, GIF, JPEG or WebP bytes; None if they can't be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return None
                kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + size
    except (TypeError, struct.error):
        pass
    return None


@F.pandas_udf(IntegerType())
def resolution_of_bytes(data: pd.Series) -> pd.Series:
    """The smaller side; null for what can't be read."""
    return pd.Series([min(s) if (s := header_size(d)) else None for d in data], dtype="Int32")


@F.pandas_udf(BooleanType())
def decode_ok(data: pd.Series) -> pd.Series:
    return pd.Series([header_size(d) is not None for d in data])


def frame_indices(count: int, n: int) -> list[int]:
    """Up to ``n`` evenly spaced frames."""
    return sorted({int(i) for i in np.linspace(0, max(count - 1, 0), n)})


def motion_of(frames: np.ndarray) -> float:
    """Mean absolute change of grey between neighbouring frames, over 255; 0 for a single frame."""
    if len(frames) < 2:
        return 0.0
    grey = np.asarray(frames, np.float32).mean(axis=-1)
    return float(np.abs(np.diff(grey, axis=0)).mean() / 255)


def scene_cuts_of(frames: np.ndarray, threshold: float = 0.5) -> int:
    """Neighbouring frames whose colour histograms (16 bins a channel, summing to 1) differ by more than ``threshold``."""
    hists = []
    for f in np.asarray(frames):
        h = np.concatenate([np.histogram(f[..., c], bins=16, range=(0, 255))[0] for c in range(3)]).astype(np.float64)
        hists.append(h / max(h.sum(), 1))
    return int(sum(np.abs(b - a).sum() > threshold for a, b in zip(hists, hists[1:])))


def video_clip_score(frames: np.ndarray, caption: np.ndarray) -> float:
    """Mean of a clip's own frame embeddings, made unit length, times the caption's."""
    m = np.asarray(frames, np.float64).mean(axis=0)
    return float(m @ np.asarray(caption, np.float64) / max(np.linalg.norm(m), 1e-12))
