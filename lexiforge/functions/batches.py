"""Arrow batches inside Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a column, or values of lists, that a worker takes at a time. Its objects for them are many times as large.
PART = 1 << 20


def parts(batch: pa.RecordBatch, column: str, limit: int = PART) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices with about ``limit`` bytes of a column of strings, or as many values of a column of
    lists; a row with more is a slice of its own."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    upto = np.cumsum(pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin, before = 0, 0
    while begin < len(upto):
        end = max(begin + 1, int(np.searchsorted(upto, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin, before = end, int(upto[end - 1])
