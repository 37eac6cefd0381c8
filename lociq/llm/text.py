"""Vectorised text kernels on Arrow batches: word spans, word hashes and per-document reductions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of whole rows of about `most` text bytes, with their bytes and offsets."""
    for batch in batches:
        data, offs = text_bytes(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
            hi = min(hi, batch.num_rows)
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word `[^\\x20\\x09-\\x0D]+`; no word crosses rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_SPACE[data]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], last[-1] = True, True
    np.logical_not(word[:-1], out=first[1:])
    np.logical_not(word[1:], out=last[:-1])
    edges = offs[(offs > 0) & (offs < n)]
    first[edges] = True
    last[edges - 1] = True
    starts = np.flatnonzero(word & first)
    return starts, np.flatnonzero(word & last) + 1, np.searchsorted(offs, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step, all spans together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(lens.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))
    live, pos, left = np.arange(len(starts)), starts.astype(np.int64), lens.astype(np.int64)
    while len(live):
        block = view[pos]
        short = left < 8
        block[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        h[live] = mix(h[live] ^ block) + U64(0x9E3779B97F4A7C15)
        more = left > 8
        live, pos, left = live[more], pos[more] + 8, left[more] - 8
    return mix(h)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of distinct `width`-word shingle hashes, ascending, as one array and its row offsets.

    ASCII letters are lower-cased. A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    data = lower(data)
    starts, ends, row = word_spans(data, offs)
    rows = len(offs) - 1
    h = span_hash(data, starts, ends - starts)
    count = np.bincount(row, minlength=rows)
    at = np.concatenate([[0], np.cumsum(count)])
    full = max(0, len(h) - width + 1)
    seed = [U64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1) for k in range(width + 1)]
    joined = np.full(full, seed[width])
    for k in range(width):
        joined = mix(joined ^ h[k : k + full])
    inside = np.flatnonzero(row[:full] == row[width - 1 : width - 1 + full]) if full else np.zeros(0, np.int64)
    values, owner = [joined[inside]], [row[:full][inside]]
    for r in np.flatnonzero((count > 0) & (count < width)):
        x = seed[count[r]][None]
        for y in h[at[r] : at[r + 1]]:
            x = mix(x ^ y)
        values.append(x)
        owner.append(np.array([r]))
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(rows + 1))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]], empty rows 0; wraps for unsigned values."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


class KeyCounter:
    """Counts of long keys, merged now and then so that memory follows the distinct keys of a task, not its tokens."""

    def __init__(self, most: int = 1_500_000):
        self.most, self.parts, self.pending = most, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.pending += len(self.parts[-1][0])

    def full(self) -> bool:
        return self.pending > self.most

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[first], np.add.reduceat(counts, first))]
        self.pending = len(first)
        return self.parts[0]

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            keys, counts = self.merge()
            self.parts, self.pending = [], 0
            for lo in range(0, len(keys), 200_000):
                yield keys[lo : lo + 200_000], counts[lo : lo + 200_000]
