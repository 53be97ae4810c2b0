"""Words, hashes and byte windows of whole Arrow columns in numpy; about a MB of text at a time, never a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64

#: Odd bases of the two rolling hashes, and the multipliers of a 64-bit finaliser.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

#: The bytes that part words: space, and tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, U)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(MIX[0])
    x = (x ^ (x >> U(33))) * U(MIX[1])
    return x ^ (x >> U(33))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(batches: Iterator[pa.RecordBatch], text: str | tuple[str, str] = "text", most: int = 1 << 20, most_rows: int = 1 << 31) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) of about `most` bytes of text and at most most_rows rows each; a longer text comes alone.

    text is a column or (struct column, field). Once all is read, memory that isn't used any more goes back to the system: the worker may stand idle for long.
    """
    for b in batches:
        if not b.num_rows:
            continue
        column = b.column(b.schema.get_field_index(text if isinstance(text, str) else text[0]))
        if not isinstance(text, str):
            column = pc.struct_field(column, [column.type.get_field_index(text[1])])
        data, off = column_bytes(column)
        lo = 0
        while lo < b.num_rows:
            hi = min(lo + most_rows, max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1))
            yield b.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi
    b = column = data = off = None
    pa.default_memory_pool().release_unused()


@dataclass
class Words:
    start: np.ndarray  # byte where each word starts, and
    end: np.ndarray  # ends
    first: np.ndarray  # index of each text's first word, and one more for the end
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, off: np.ndarray) -> Words:
    """The words of each text and a 64-bit hash of each word's bytes."""
    n = len(data)
    inside = ~SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < n]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = off[1:][off[1:] > 0] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BYTE_BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(inverse(BYTE_BASE), n + 1)[start]
    return Words(start, end, np.searchsorted(start, off), mix(h + (end - start).astype(U)))


def spaced(w: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all words' bytes with one space after each, where each word starts in them, and the end)."""
    at = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(w.end - w.start + 1, out=at[1:])
    out = np.full(at[-1], 0x20, np.uint8)
    inside = data[~SEPARATOR[data]]
    out[np.arange(len(inside)) + np.repeat(np.arange(len(w.start)), w.end - w.start)] = inside
    return out, at


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive items of h; the caller leaves out those that cross an edge."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * powers(WORD_BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(inverse(WORD_BASE), n + 1)[: n - k + 1])


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))
