"""Rows of one key at a time from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One record batch for each run of equal keys; the input is sorted by them. Holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def out() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new).tolist()
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield out()
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield out()
