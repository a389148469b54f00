"""Numpy arrays in one binary value: bytes of equal rank together, compressed."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any numeric kinds as one compressed value."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        code = a.dtype.str.encode()
        head.append(struct.pack("<BQ", len(code), len(a)) + code)
        raw = np.ascontiguousarray(a).view(np.uint8)
        body.append(raw.reshape(-1, a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else raw.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(value: bytes) -> list[np.ndarray]:
    """The arrays of `pack`."""
    raw = zstandard.ZstdDecompressor().decompress(value)
    at, shapes = 1, []
    for _ in range(raw[0]):
        size, n = struct.unpack_from("<BQ", raw, at)
        shapes.append((np.dtype(raw[at + 9 : at + 9 + size].decode()), n))
        at += 9 + size
    out = []
    for kind, n in shapes:
        part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(part.reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.empty(0, kind))
        at += n * kind.itemsize
    return out
