"""Sorted rows of tasks as whole groups, so that a helper can work on many small groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each run of equal keys; nulls are equal."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        c = table.column(k)
        one, before = c.slice(1), c.slice(0, table.num_rows - 1)
        change[1:] |= pc.fill_null(pc.not_equal(one, before), True).to_numpy() & ~(one.is_null().to_numpy() & before.is_null().to_numpy())
    return np.flatnonzero(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size, most: int = 1 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each group) of rows sorted by keys: groups are never cut, and come together up to a sum of
    size(rows), a number for each row, of about `most`."""

    def pieces(table: pa.Table, first: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = table.combine_chunks()
        upto = np.cumsum(np.add.reduceat(size(table), first)) // most
        ends = [*(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(first)]
        at = 0
        for end in ends:
            row, stop = int(first[at]), int(first[end]) if end < len(first) else table.num_rows
            yield table.slice(row, stop - row), first[at:end] - row
            at = end

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        first = starts(table, keys)
        cut = int(first[-1])  # the last group may go on in the next batch
        if cut:
            yield from pieces(table.slice(0, cut), first[:-1])
        rest = table.slice(cut)
    if rest is not None:
        yield from pieces(rest, np.zeros(1, np.int64))


def numbers(table: pa.Table, name: str, null: int = 0) -> np.ndarray:
    return pc.fill_null(table.column(name), null).to_numpy().astype(np.int64)


def ends_of(pointers: np.ndarray) -> np.ndarray:
    """Where each chain of pointers ends, at a place that points to itself."""
    while True:
        far = pointers[pointers]
        if (far == pointers).all():
            return pointers
        pointers = far
