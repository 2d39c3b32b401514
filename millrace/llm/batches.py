"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as str, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about `most` characters in each (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys (one key column or several)."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096, least_bytes: int = 1 << 24) -> Iterator[pa.Table]:
    """Regroups batches that are sorted by keys, so that no group is cut between two tables.

    A table holds the groups that fit about `least` rows or bytes; a group is held whole,
    so the caller must bound the size of a group before the shuffle.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < least and size < least_bytes:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = _last_group(table, keys)
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
        size = sum(b.nbytes for b in held)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _last_group(table: pa.Table, keys: list[str]) -> int:
    columns = [table.column(k).to_numpy() for k in keys]
    start = 0
    for c in columns:
        differs = np.flatnonzero(c != c[-1])
        if len(differs):
            start = max(start, int(differs[-1]) + 1)
    return start
