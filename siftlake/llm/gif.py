"""Media columns: GIF.

``decode`` reads a GIF: LZW code streams, global and local palettes, interlace,
transparency and the disposal of frames, each composed on the canvas with its
delay. ``frames_of`` makes a column of timed frames with colour histograms from
a column of GIFs. ``encode`` writes frames of palette indices; texts are stored
with it losslessly, a byte as one 8-bit sample, in frames of 64 columns.

Defined results: a null or unreadable GIF has null frames, and so has one whose
canvas passes ``MOST`` pixels (a header of a few bytes could else ask for 17 GB);
a GIF cut short, or with a frame larger than that, has the frames before it; parts
of a frame outside the canvas aren't shown. A column that has the name of the
frames' column is replaced. A null text is empty and stored as 64 zero bytes; rows
that repeat a doc_id are stored each.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import bound_batches, map_arrow, text_bytes

COLUMNS, ROWS = 64, 4096  # samples in a row, rows in a frame of stored text
MOST = 1 << 26  # pixels of a canvas or frame that are decoded
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


@functools.cache
def _widths(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By how many codes stand before it since the last clear code: bits of a code, as a mask, and bits before it."""
    last = np.minimum((1 << size) + 1 + np.arange(8192), 4095)
    widths = np.floor(np.log2(last)).astype(np.int64) + 1
    return widths, np.arange(16) < widths[:, None], np.concatenate([[0], np.cumsum(widths)])


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of ``data``: codes of growing width, a clear code when the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    runs: list[list[int]] = []  # codes from one clear code to the next, that included
    codes: list[int] = []
    if data:
        put, table, free, prefix = codes.append, {}, end + 1, data[0]
        get = table.get
        for b in data[1:]:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            if free < 4096:
                table[key] = free
                free += 1
            else:
                put(clear)
                runs.append(codes)
                codes = []
                put = codes.append
                table.clear()
                free = end + 1
            prefix = b
        put(prefix)
    codes.append(end)
    runs.append(codes)
    mask = _widths(size)[1]
    bits = [_bits([clear])[:, : size + 1].ravel()]
    bits += [_bits(r)[mask[: len(r)]] for r in runs]
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def _bits(codes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream."""
    clear, end = 1 << size, (1 << size) + 1
    whole = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    word = whole[:-3] | whole[1:-2] << 8 | whole[2:-1] << 16
    bits, place, number = 8 * len(stream), 0, 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, prev, out, made = base.copy(), None, [], 0
    widths, _, before = _widths(size)
    # the width of a code depends on how many stand before it since the last clear code, so many are read at once
    while place + size < bits and made < most:
        number = min(number, 4096)
        n = min(3900, int(np.searchsorted(before[number:], bits - place + before[number], side="right")) - 1)
        if n <= 0:
            break
        begins = before[number : number + n] - before[number] + place
        codes = (word[begins >> 3] >> (begins & 7).astype(np.uint32)) & ((1 << widths[number : number + n]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n, at = int(stop[0]) if len(stop) else n, len(out)
        todo = codes[:n].tolist()
        put, grow = out.append, table.append
        if prev is None and todo:
            if todo[0] >= clear:
                break
            prev = table[todo.pop(0)]
            put(prev)
        room = max(0, 4096 - len(table))
        try:
            for code in todo[:room]:
                try:
                    s = table[code]
                except IndexError:
                    if code != len(table):
                        raise
                    s = prev + prev[:1]
                grow(prev + s[:1])
                put(s)
                prev = s
            for code in todo[room:]:
                prev = table[code]
                put(prev)
        except IndexError:  # no such code
            break
        made += sum(map(len, out[at:]))
        place = int(begins[n - 1] + widths[number + n - 1]) if n else place
        number += n
        if len(stop):
            if codes[n] == end:
                break
            place += int(widths[number])
            table, prev, number = base.copy(), None, 0
    return b"".join(out)[:most]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def encode(frames: list[dict], width: int, height: int, palette: np.ndarray = GREY) -> bytes:
    """A GIF of ``frames``: indices (rows x columns), and delay, left, top, disposal, transparent if wanted."""
    depth = max(1, (len(palette) - 1).bit_length())
    table = np.zeros((1 << depth, 3), np.uint8)
    table[: len(palette)] = palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | (depth - 1), 0, 0), table.tobytes()]
    for f in frames:
        x, clear = f["indices"], f.get("transparent")
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.get("disposal", 1) << 2 | (clear is not None), f.get("delay", 10), clear or 0, 0))
        size = max(2, depth)
        out.append(struct.pack("<BHHHHBB", 0x2C, f.get("left", 0), f.get("top", 0), x.shape[1], x.shape[0], 0, size))
        stream = lzw_encode(x.tobytes(), size)
        out += [bytes([len(p := stream[i : i + 255])]) + p for i in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b";"])


def decode(data: bytes) -> Iterator[dict]:
    """Frames in order: indices, delay, disposal, transparent, left, top, and the canvas (RGBA) as shown."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
        at += 3 * n
    if width * height > MOST:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    transparent = None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            block, at = _blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                disposal, delay = block[0] >> 2 & 7, block[1] | block[2] << 8
                transparent = block[3] if block[0] & 1 else None
        elif data[at] == 0x2C and at + 10 <= len(data):
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at, palette = at + 10, shared
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
                at += 3 * n
            if palette is None or at >= len(data):
                return
            size = data[at]
            stream, at = _blocks(data, at + 1)
            if not 1 <= size <= 8 or w * h > MOST:
                return
            samples = lzw_decode(stream, size, w * h)
            if len(samples) < w * h:  # cut short
                return
            indices = np.frombuffer(samples, np.uint8).reshape(h, w)
            if flags & 0x40:
                rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
                straight = np.empty_like(indices)
                straight[rows] = indices
                indices = straight
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            seen = indices[: part.shape[0], : part.shape[1]]
            full = np.zeros((256, 4), np.uint8)
            full[: len(palette), :3] = palette
            full[:, 3] = 255
            if transparent is None:
                part[:] = full[seen]
            else:
                shown = seen != transparent
                part[shown] = full[seen[shown]]
            yield {"indices": indices, "delay": delay, "disposal": disposal, "transparent": transparent, "left": left, "top": top, "canvas": canvas.copy()}
            if disposal == 2:
                part[:] = 0
            elif before is not None:
                canvas = before
            delay, disposal, transparent = 0, 0, None
        else:
            return


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels of each of 64 colours (two bits a channel); transparent ones don't count."""
    c = canvas.reshape(-1, 4)
    c = c[c[:, 3] > 0]
    return np.bincount((c[:, 0] >> 6).astype(np.int64) << 4 | (c[:, 1] >> 6) << 2 | c[:, 2] >> 6, minlength=64)


def store(payload: bytes) -> bytes:
    """``payload``, a multiple of 64 bytes, as grey samples."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    return encode([{"indices": x[i : i + ROWS]} for i in range(0, len(x), ROWS)], COLUMNS, min(len(x), ROWS))


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % COLUMNS or COLUMNS * (not text))


def frames_of(media: DataFrame, column: str = "media", name: str = "frames") -> DataFrame:
    """``media`` with a column of frames: array of (delay, disposal, left, top, width, height, histogram)."""
    bound_batches(media.sparkSession)
    rest = [c for c in media.columns if c != name]
    kind = "array<struct<delay:int,disposal:int,left:int,top:int,width:int,height:int,histogram:array<long>>>"
    schema = media.limit(0).select(*[F.col(f"`{c}`") for c in rest], F.lit(None).cast(kind).alias(name)).schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in b.column(column).to_pylist():
            try:
                out.append(None if data is None else [{k: f[k] for k in ("delay", "disposal", "left", "top")} | {"width": f["indices"].shape[1], "height": f["indices"].shape[0], "histogram": histogram(f["canvas"]).tolist()} for f in decode(data)])
            except (ValueError, IndexError, struct.error):
                out.append(None)
        i32 = pa.int32()
        item = pa.struct([("delay", i32), ("disposal", i32), ("left", i32), ("top", i32), ("width", i32), ("height", i32), ("histogram", pa.list_(pa.int64()))])
        return b.select(rest).append_column(name, pa.array(out, pa.list_(item)))

    return map_arrow(media, run, schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): every text as a GIF."""
    bound_batches(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column("doc_id"), pa.array([store(padded(t)) for t in text_bytes(b.column("text"))], pa.binary())], ["doc_id", "media"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, media binary")


def store_and_read(docs: DataFrame) -> DataFrame:
    """A digest of every text as stored in a GIF and read back."""
    bound_batches(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))):
            media, n = store(padded(text)), 0
            whole, tail, colours = hashlib.sha256(), b"", np.zeros(64, np.int64)
            for f in decode(media):
                samples = f["indices"].tobytes()
                whole.update(samples)
                n, tail, colours = n + len(samples), samples[-64:], colours + histogram(f["canvas"][: len(f["indices"])])
            feature = ",".join(f"{i}:{c}" for i, c in enumerate(colours.tolist()) if c)
            rows.append((k, len(text), n, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
