"""Vectorised work on text columns inside Python tasks: words, hashes, shingles.

Everything here takes the bytes of an Arrow string column as one numpy buffer,
so a batch of documents costs a few array passes and no Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; bounds the memory of the per-byte arrays.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch so that each part has about `limit` bytes of text (one row at least)."""
    data, at = column_bytes(batch.column(batch.schema.get_field_index(name)))
    row, rows = 0, batch.num_rows
    while row < rows:
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words of all rows; row i has words first[i]:first[i + 1].

    A word is a run without ASCII white space; rows never share one.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), dtype=np.uint64)
    row = 0
    while row < len(starts):  # a few MB of bytes at a time
        end = max(row + 1, int(np.searchsorted(ends, starts[row] + SLICE_BYTES, side="right")))
        a, b = starts[row], ends[end - 1]
        part = _LOWER[data[a:b]] if lower else data[a:b]
        s, e = starts[row:end] - a, ends[row:end] - a
        sizes = e - s
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum()), dtype=np.int64)
        within = place - np.repeat(first, sizes)
        powers = np.ones(int(sizes.max()), dtype=np.uint64)
        powers[1:] = _BASE
        powers = np.cumprod(powers, dtype=np.uint64)
        value = _BYTE[part[within + np.repeat(s, sizes)]] * powers[within]
        out[row:end] = np.add.reduceat(value, first) + sizes.astype(np.uint64)
        row = end
    return mix(out)


def windows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, places): every window of `size` words that lies within one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        value = value * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    good = np.arange(n) + size <= first[row + 1]
    return mix(value[good]), row[good], (np.arange(n) - first[row])[good]


def sets_by_row(values: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending: (all values, where each row starts)."""
    order = np.lexsort((values, rows)) if len(values) else np.zeros(0, np.int64)
    values, rows = values[order], rows[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(count + 1))


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each row as hashes: (all values, where each row starts).

    A row with fewer words than `size` has its whole word sequence as its one
    shingle; a row without words has none.
    """
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends, lower)
    values, rows, _ = windows(words, first, size)
    counts = np.diff(first)
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            value = np.full(len(short), k, dtype=np.uint64)
            for j in range(k):
                value = value * np.uint64(0xD6E8FEB86659FD93) + words[first[short] + j]
            values, rows = np.concatenate([values, mix(value)]), np.concatenate([rows, short])
    return sets_by_row(values, rows, len(at) - 1)


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first, rows, places): the words of every line that has some; line i has words first[i]:first[i + 1].

    `rows` and `places` say in which row a line stands, and as which of its \\n-split lines, from 0.
    """
    starts, ends, first = word_spans(data, at)
    words = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    breaks = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, at[:-1])[row]
    lead = np.ones(len(words), dtype=bool)
    lead[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    begin = np.flatnonzero(lead)
    return words, np.append(begin, len(words)), row[begin], line[begin]


def sequence_hashes(words: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word sequence words[first[i]:first[i + 1]], none of them empty."""
    if len(first) < 2:
        return np.zeros(0, np.uint64)
    place = (np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    return mix(np.add.reduceat(mix(words + (place + np.uint64(seed)) * _BASE), first[:-1]))


def binary_column(values: np.ndarray, first: np.ndarray, width: int = 8) -> pa.Array:
    """64-bit values as one binary cell a row; row i holds values[first[i]:first[i + 1]]. Of each its `width` leading bytes are kept."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :])
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((width * first).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def values_of(column: pa.Array, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(values, first) of a column of `binary_column`."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    full = np.zeros((len(raw) // width, 8), np.uint8)
    full[:, 8 - width :] = raw.reshape(-1, width)
    return full.reshape(-1).view("<u8").astype(np.uint64, copy=False), (at - at[0]) // width


def similar_pairs(batches: Iterator[pa.RecordBatch], percent: int, width: int = 8) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, b, set of a, set of b) whose sets, ascending in a binary cell each, are similar enough."""
    for batch in batches:
        (one, begin), (two, start) = values_of(batch.column(2), width), values_of(batch.column(3), width)
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            a, b = one[begin[i] : begin[i + 1]], two[start[i] : start[i + 1]]
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            if not len(small) or 100 * len(small) < percent * len(large):
                continue
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])
