"""PNG images in binary columns: encoding, checked decoding and cosine-transform hashes.

The decoder walks the chunks of a PNG, tests every CRC-32, inflates the pixel
stream (whose Adler-32 zlib tests) and undoes the five row filters with numpy.
The hash keeps the low frequencies of the image's cosine transform: images that
look alike get hashes that differ in few bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import small_batches

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_SIDE, _LOW = 32, 8
_COSINES = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5) * np.arange(_LOW)[:, None])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray, level: int = 4, kinds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> bytes:
    """A PNG of uint8 pixels [height, width, channels]; each row takes that of the filters `kinds` with the least sum of magnitudes, the first of equals."""
    height, width, channels = pixels.shape
    rows = pixels.reshape(height, width * channels)
    out = np.empty((height, rows.shape[1] + 1), np.uint8)
    tried = [_filtered(rows, channels, k) for k in kinds]
    best = np.stack([np.minimum(x, 0 - x).sum(axis=1, dtype=np.int64) for x in tried]).argmin(axis=0)
    for i, x in enumerate(tried):
        out[best == i, 0], out[best == i, 1:] = kinds[i], x[best == i]
    kind = {c: k for k, c in _CHANNELS.items()}[channels]
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out, level)) + _chunk(b"IEND", b"")


def _guess(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of left, up and corner (int16) the one nearest to left + up - corner, in this order if equal."""
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def _filtered(rows: np.ndarray, step: int, kind: int) -> np.ndarray:
    """All rows under one of the five filters; `step` bytes make a pixel."""
    wide = np.zeros((len(rows) + 1, rows.shape[1] + step), np.int16)
    wide[1:, step:] = rows
    left, up, corner = wide[1:, :-step], wide[:-1, step:], wide[:-1, :-step]
    guess = (np.zeros_like(left), left, up, (left + up) >> 1, _guess(left, up, corner) if kind == 4 else None)[kind]
    return (rows - guess).astype(np.uint8)


def _unfilter(kinds: np.ndarray, data: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters of [height, row bytes].

    Runs of rows that look left or up only are summed along rows or columns;
    in runs with other filters, all pixels of an anti-diagonal are undone
    at once, as each depends on those before it only.
    """
    if (kinds > 4).any():
        raise ValueError(f"row filter {int(kinds.max())}")
    out = np.zeros((len(data) + 1, data.shape[1] + step), np.uint8)  # a row above and a pixel before
    out[1:, step:] = data
    group = np.where(kinds > 2, 3, kinds)
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
        part = out[lo + 1 : hi + 1, step:]
        if group[lo] == 1:
            part[:] = np.cumsum(part.reshape(hi - lo, -1, step), axis=1, dtype=np.uint8).reshape(part.shape)
        elif group[lo] == 2:
            part[:] = np.cumsum(out[lo : hi + 1, step:], axis=0, dtype=np.uint8)[1:]
        elif group[lo] == 3:
            _diagonals(out[lo : hi + 1], kinds[lo:hi], step)
    return out[1:, step:]


def _diagonals(rows: np.ndarray, kinds: np.ndarray, step: int) -> None:
    """Undo filters 3 and 4 in place; the first row is done, and each row begins with a pixel of zeros."""
    grid = rows.reshape(len(rows), -1, step)
    height, width = len(kinds), grid.shape[1] - 1
    mean = kinds == 3
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y + 1
        left, up, corner = (grid[i, j].astype(np.int16) for i, j in ((y + 1, x - 1), (y, x), (y, x - 1)))
        guess = np.where(mean[y][:, None], (left + up) >> 1, _guess(left, up, corner))
        grid[y + 1, x] += guess.astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """Pixels [height, width, channels] of an 8-bit PNG that isn't interlaced; ValueError if any check fails."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, stream, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r}: wrong CRC-32")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("IHDR has a wrong length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, color, _, _, interlaced = head
    if depth != 8 or color not in _CHANNELS or interlaced:
        raise ValueError("not an 8-bit PNG of gray or colour samples in row order")
    channels = _CHANNELS[color]
    try:
        raw = zlib.decompress(b"".join(stream))
    except zlib.error as e:
        raise ValueError(f"pixel stream: {e}") from None
    if len(raw) != height * (width * channels + 1):
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return _unfilter(rows[:, 0], rows[:, 1:], channels).reshape(height, width, channels)


def _shrunk(gray: np.ndarray) -> np.ndarray:
    """Mean gray of a 32 x 32 grid over the image (edges by linear interpolation of the running sums)."""
    for axis in (0, 1):
        n = gray.shape[axis]
        total = np.concatenate([np.zeros_like(gray.take([0], axis)), np.cumsum(gray, axis)], axis)
        edge = np.arange(_SIDE + 1) * (n / _SIDE)
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low).reshape((-1, 1) if axis == 0 else (1, -1))
        at = total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part
        gray = np.diff(at, axis=axis) * (_SIDE / n)
    return gray


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the gray image exceed their median (the mean left out of it)."""
    low = _COSINES @ _shrunk(pixels.mean(axis=2, dtype=np.float64)) @ _COSINES.T
    low = np.round(low, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def text_pixels(text: bytes, width: int = 64, pad: int = 32) -> np.ndarray:
    """Bytes as RGB samples, padded to whole rows, one at least."""
    size = width * 3
    whole = max(1, -(-len(text) // size)) * size
    return np.frombuffer(text.ljust(whole, bytes([pad])), np.uint8).reshape(-1, width, 3)


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 64, level: int = 4, kinds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """id, n_bytes, media (PNG, binary): each text's UTF-8 bytes as an image, losslessly, its rows under the filters `kinds`.

    A null text counts as empty and becomes one row of spaces; null ids and
    repeated rows are kept; other columns are not read; a text of any length
    is one image, in the memory of one task.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = pa.array([encode_png(text_pixels(t, width), level, kinds) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), media], names=["id", "n_bytes", "media"])

    rows = small_batches(docs).selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(stored, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Decode each PNG with all checks and describe it: payload size and digests, media size and digest, phash (binary, 8 bytes).

    A null or damaged image fails the job with the reason: the column is written by this module.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                pixels = decode_png(data)
                payload = pixels.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    kind = media.schema[id_col].dataType.simpleString()
    rows = small_batches(media).selectExpr(f"`{id_col}` AS id", "n_bytes", "media")
    out = rows.mapInArrow(read, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, phash binary")
    return out.withColumnRenamed("id", id_col)
