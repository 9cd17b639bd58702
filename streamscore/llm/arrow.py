"""Helpers for work on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `limit` bytes in `column`, at least a row each."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[values.offset :][: batch.num_rows + 1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges [start, start + count) one after the other."""
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(len(shift))


def cut(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of UTF-8 bytes that end at ASCII white space, each of little more than `size`."""
    start = 0
    while end := re.compile(rb"[\t-\r ]").search(data, start + size):
        yield data[start : end.end()]
        start = end.end()
    yield data[start:]
