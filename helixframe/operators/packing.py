"""Sorted numbers as compressed differences, so that many of them travel as one value of a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_HEAD = np.dtype([("width", "<u1"), ("n", "<u8")])


def sorting(values: np.ndarray, bits: int) -> np.ndarray:
    """The places of values below 2 ** bits in their order. Where a value and its place fit one number, these are sorted, which is some six times as fast."""
    more = max(len(values) - 1, 1).bit_length()
    if bits + more > 63:
        return np.argsort(values, kind="stable")
    return np.sort((values.astype(np.int64) << more) | np.arange(len(values))) & ((1 << more) - 1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers that aren't negative, the first one sorted: bytes of equal weight stand together, since most of the upper ones are 0."""
    parts = []
    for values in (np.diff(columns[0], prepend=columns[0][:1] * 0), *columns[1:]):
        values = np.ascontiguousarray(values, "<u8")
        width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        parts += [np.array([(width, len(values))], _HEAD).tobytes(), values.view(np.uint8).reshape(-1, 8).T[:width].tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of pack."""
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at, out = 0, []
    while at < len(raw):
        width, n = np.frombuffer(raw, _HEAD, 1, at)[0].tolist()
        at += _HEAD.itemsize
        values = np.zeros((n, 8), np.uint8)
        values[:, :width] = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T
        at += width * n
        values = values.view("<i8").ravel()
        out.append(values if out else np.cumsum(values))
    return out
