"""Words of many texts at once, on the byte buffers of Arrow columns; small helpers for code that runs inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: white space, or everything in ASCII but letters and digits.
SPACES = bytes([9, 10, 11, 12, 13, 32])
NOT_ALNUM = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
CHUNK_BYTES = 2 << 20


def lowered_table(separators: bytes) -> bytes:
    """Translation that lower-cases A-Z and turns every separator into a space."""
    t = bytearray(range(256))
    t[65:91] = bytes(range(97, 123))
    for c in separators:
        t[c] = 32
    return bytes(t)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 borders between them; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, borders, data = column.buffers()
    off = np.frombuffer(borders, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, row after the last, bytes, borders.

    A longer text is a run of its own.
    """
    buf, off = buffers(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(buf: np.ndarray, off: np.ndarray, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words without separators, the borders between the words, and the borders between the texts in words."""
    low = np.frombuffer(buf.tobytes().translate(table), np.uint8)
    inside = low != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = off[1:-1]
    at = at[(at > 0) & (at < len(low))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    begin = np.flatnonzero(first)
    borders = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - begin, out=borders[1:])
    return low[inside], borders, np.searchsorted(begin, off)


def strings(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    """The words as an Arrow array, without a copy."""
    return pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(np.ascontiguousarray(borders)), pa.py_buffer(data))


def release() -> None:
    """Gives back to the system what a batch has used: workers live on and would hold it beside the next stage's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)
