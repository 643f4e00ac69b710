"""The words of an Arrow batch of texts as numbers, for the phrase index and the impact index.

Words are the maximal runs of ASCII digits, ASCII letters (lower-cased) and all other characters from U+0080 on.
A batch is worked on as one run of UTF-8 bytes: no byte of a longer character is below 0x80, so words end
where bytes say. A batch of documents is a *segment*: its number is the partition's and the batch's.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark import TaskContext

#: Each byte's lower-case form if it belongs to a word, else 0.
_WORD = np.zeros(256, np.uint8)
for _range in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
    _WORD[_range] = _range
_WORD[0x41:0x5B] = _WORD[0x61:0x7B]


class Words(NamedTuple):
    """Of a batch, in reading order: each word's number in ``terms``, its row; and the number of words of each row."""

    codes: np.ndarray
    rows: np.ndarray
    counts: np.ndarray
    terms: object


def _runs(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (0 where no word is), starts and ends of words, the rows' edges."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_binary())
    edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    low = _WORD[np.frombuffer(data if data is not None else b"", np.uint8)[edges[0] : edges[-1]]]
    edges = edges - edges[0]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a word ends with its row
    border = edges[(edges > 0) & (edges < len(low))]
    first[border], last[border - 1] = inside[border], inside[border - 1]
    return low, np.flatnonzero(first), np.flatnonzero(last) + 1, edges


def counts(column) -> np.ndarray:
    """The number of words of each row."""
    _, starts, _, edges = _runs(column)
    return np.diff(np.searchsorted(starts, edges))


def words(column) -> Words:
    import pyarrow as pa

    low, starts, ends, edges = _runs(column)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[low != 0])]).dictionary_encode()
    n = np.diff(np.searchsorted(starts, edges))
    return Words(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n), n, found.dictionary.cast(pa.binary()))


def segment(batch: int) -> int:
    return (TaskContext.get().partitionId() << 24) + batch


def binaries(data: np.ndarray, edges: np.ndarray):
    """An Arrow array of binaries: the bytes of ``data`` between each two edges (counted in bytes)."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
