"""Whole Arrow batches of text at a time: words and their 64-bit hashes as NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is taken alone.
SLICE_BYTES = 1_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, SLICE_BYTES)
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        back = np.full(size, _INVERSE, dtype=np.uint64)
        back[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _POWERS, _INVERSES


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more entry than texts). Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text, and of `rows` rows at most."""
    if not len(column):
        return
    offsets = text_bytes(column)[1]
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1)
        end = min(end, len(column), start + (rows or len(column)))
        yield start, end
        start = end


class Words:
    """Words of texts, A-Z in lower case.

    data: lower-case bytes; starts, ends: of each word in data; counts: words
    of each text; doc: text of each word; hashes: 64 bits of each word. raw: the
    bytes as they are; offsets: where each text begins in them.
    """

    def __init__(self, column: pa.Array) -> None:
        raw, offsets = text_bytes(column)
        self.raw, self.offsets, self.data = raw, offsets, _LOWER[raw]
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[self.data]
        # a word starts inside where the byte before is blank or of another text
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]
        first[edges] = inside[1:-1][edges]
        last[edges - 1] = inside[1:-1][edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(at)
        self.first_word = at[:-1]
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        powers, self._inverses = _powers(len(raw) + 1)
        self._total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_CODES[self.data] * powers[: len(raw)], out=self._total[1:])
        self.hashes = self.range_hashes(self.starts, self.ends)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the given ranges of data, equal for equal bytes."""
        return mix((self._total[ends] - self._total[starts]) * self._inverses[starts])


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 2-word shingles: (values sorted per text, where each text's begin, one more entry than texts).

    A text of one word has that word as its shingle; without words it has none.
    """
    h, n = words.hashes, len(words.counts)
    pair = mix(h[:-1] * np.uint64(3) + (h[1:] << np.uint64(1) | np.uint64(1))) if len(h) > 1 else h[:0]
    parts = []
    for first, count in zip(words.first_word.tolist(), words.counts.tolist(), strict=True):
        if count > 1:
            run = np.sort(pair[first : first + count - 1])
            new = np.empty(len(run), dtype=bool)
            new[0] = True
            np.not_equal(run[1:], run[:-1], out=new[1:])
            parts.append(run[new])
        elif count:
            parts.append(mix(h[first : first + 1] ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            parts.append(h[:0])
    begins = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=begins[1:])
    return np.concatenate(parts) if parts else h[:0], begins
