"""Arrow batches of sorted partitions, cut where groups end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def starts(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """For each row whether it begins a group: it differs from the row before in some key, null being equal to null."""
    n = table.num_rows
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for k in keys:
            c = table.column(k)
            a, b = c.slice(1), c.slice(0, n - 1)
            unlike = pc.fill_null(pc.not_equal(a, b), pa.scalar(False))
            one_null = pc.not_equal(a.is_null(), b.is_null())
            new[1:] |= pc.or_(unlike, one_null).to_numpy(zero_copy_only=False)
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by `keys`, in tables of about `rows` rows in which every group is whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(starts(table, keys))[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)
