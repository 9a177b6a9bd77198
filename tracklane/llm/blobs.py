"""Columns of numbers as one compressed binary value, and places of keys in a sorted array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length: their length, then their bytes plane by plane, compressed."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n, kinds = int.from_bytes(blob[:8], "little"), [np.dtype(k) for k in kinds]
    if not n:
        return [np.zeros(0, dtype=k) for k in kinds]
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(blob)[8:], decompressed_size=n * sum(k.itemsize for k in kinds)), dtype=np.uint8)
    out, at = [], 0
    for k in kinds:
        own = planes[at : at + n * k.itemsize].reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(own.T).view(k).reshape(n))
        at += n * k.itemsize
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: for rows that hold a blob each."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


class Places:
    """Where keys (evenly spread numbers below 2**bits) are in a sorted array of distinct ones."""

    def __init__(self, keys: np.ndarray, bits: int = 64) -> None:
        self.n = len(keys)
        self.keys = np.append(keys, np.uint64(0))
        wide = min(bits, max(1, self.n.bit_length() + 1))
        self.shift = np.uint64(bits - wide)
        self.first = np.zeros((1 << wide) + 1, dtype=np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << wide), out=self.first[1:])

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        cell = (values >> self.shift).astype(np.int64)
        at, end = self.first[cell], self.first[cell + 1]
        out = np.where((at < end) & (self.keys[at] == values), at, -1)
        open_ = np.flatnonzero((at + 1 < end) & (out < 0))
        at, end = at[open_] + 1, end[open_]
        while len(open_):
            hit = self.keys[at] == values[open_]
            out[open_[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            open_, at, end = open_[more], at[more] + 1, end[more]
        return out
