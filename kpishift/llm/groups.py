"""Runs of equal keys in a key-sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Positions where a new key begins, 0 included."""
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _key(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def whole_runs(batches, keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables that hold whole runs only, of about ``rows`` rows (a longer run alone)."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        starts = changes(batch, keys)
        if held and n >= rows:
            cut = 0 if _key(batch, keys, 0) != last else int(starts[1]) if len(starts) > 1 else -1
            if cut >= 0:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
        if len(batch):
            held.append(batch)
            n += len(batch)
            last = _key(batch, keys, len(batch) - 1)
    if held:
        yield pa.Table.from_batches(held)
