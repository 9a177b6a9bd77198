"""Arrow batches regrouped: larger ones, and groups of consecutive equal keys in sorted ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `rows`: for work whose cost is by the batch and whose rows are small."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only, with the rows at which groups begin (and the end).

    batches come sorted by keys (integers). The last group of a batch waits for the next.
    """
    held: list[pa.RecordBatch] = []

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        new[0] = True
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(batch.column(k)[batch.num_rows - 1].as_py() == held[0].column(k)[0].as_py() for k in keys):
            held.append(batch)  # still the same group
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = begins(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
        held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        at = begins(table)
        yield table, np.append(at, len(table))
