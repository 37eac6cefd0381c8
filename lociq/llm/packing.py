"""Packing token pieces into fixed-length sequences by exact complements, then best fit.

Only the number of pieces of each length decides the plan, and there are at most `capacity` lengths, so
the plan is made from a histogram of bounded size, whatever the corpus. For each length, longest first,
single, pair and triple sums that fill the gap exactly are looked up and used up as often as the counts
allow; lengths without a complement are placed by best fit. A plan row says which ranks of a length go
to which sequences and offset; pieces then find their place from their length and rank.

Null or empty text: one piece with the end id. Very long texts: pieces of `capacity` and a rest. Ties: pieces of
one length are alike, and take their places in the order of partitions and rows. Null and repeated doc_ids: see
by_key. Empty table: empty result. Other columns of the input are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.session import by_key, keep
from lociq.llm.text import pieces, table
from lociq.llm.tokens import WordEncoder, default_path

CAPACITY = 4096
PIECE = "key long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class _Complements:
    """Index of the sums that one, two or three available lengths make."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self._index()

    def _index(self) -> None:
        have = np.flatnonzero(self.counts > 0)
        self.pair_sum = np.zeros(len(self.counts), bool)
        for a in have:
            sums = a + have[have >= a]
            self.pair_sum[sums[sums < len(self.pair_sum)]] = True
        self.stale = 0

    def pair(self, gap: int, free: np.ndarray, most: int) -> tuple[int, ...] | None:
        a = np.arange(max(1, gap - most), gap // 2 + 1)
        ok = (free[a] > 0) & (free[gap - a] > np.where(2 * a == gap, 1, 0))
        hit = np.flatnonzero(ok)
        return (int(gap - a[hit[0]]), int(a[hit[0]])) if len(hit) else None

    def fill(self, gap: int, free: np.ndarray) -> tuple[int, ...] | None:
        """The combination that fills gap exactly with the longest pieces, from what is free."""
        if gap < len(free) and free[gap] > 0:
            return (gap,)
        if found := self.pair(gap, free, gap - 1):
            return found
        if self.stale > 256:
            self._index()
        have = np.flatnonzero(free[: max(gap - 1, 0)] > 0)[::-1]
        for x in have[self.pair_sum[gap - have]]:
            free[x] -= 1
            found = self.pair(gap - int(x), free, int(x))
            free[x] += 1
            if found:
                return (int(x), *found)
            self.stale += 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) for all pieces; a slot's k-th rank goes to its k-th sequence."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns: list[tuple[list[int], int]] = [([capacity], int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    sums, left = _Complements(counts), np.zeros(capacity + 1, np.int64)
    for length in range(capacity - 1, 0, -1):
        while counts[length] > 0:
            counts[length] -= 1
            found = sums.fill(capacity - length, counts)
            counts[length] += 1
            if not found:
                left[length], counts[length] = counts[length], 0
                break
            lengths = [length, *found]
            times = min(int(counts[v]) // lengths.count(v) for v in set(lengths))
            for v in lengths:
                counts[v] -= times
            patterns.append((lengths, times))
    open_bins: dict[int, list[tuple[list[int], int]]] = {}
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                each = capacity // length
                for copies, times in ((each, n // each), (n % each, 1)):
                    if copies and times:
                        open_bins.setdefault(capacity - copies * length, []).append(([length] * copies, times))
                break
            lengths, times = open_bins[gap].pop()
            used = min(times, n)
            if used < times:
                open_bins[gap].append((lengths, times - used))
            if not open_bins[gap]:
                del open_bins[gap]
            open_bins.setdefault(gap - length, []).append(([*lengths, length], used))
            n -= used
    patterns += [p for bins in open_bins.values() for p in bins]
    slots, rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in patterns:
        offset = 0
        for v in lengths:
            slots.append((v, int(rank[v]), times, sequence, offset))
            rank[v] += times
            offset += v
        sequence += times
    return slots


def cut_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """Pieces of docs (key, text), each with its rank among the pieces of its length in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, seen = TaskContext.get().partitionId(), WordEncoder.of(tokenizer), np.zeros(capacity + 1, np.int64)
        for batch, data, offs in pieces(batches):
            ids, at = encoder.encode(data, offs, end)
            size = np.diff(at)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            raw, lo = memoryview(ids.astype("<u4").tobytes()), at[:-1][row] + start
            crc = np.fromiter((zlib.crc32(raw[4 * s : 4 * (s + m)]) for s, m in zip(lo.tolist(), length.tolist())), np.int64, len(row))
            order = np.argsort(length, kind="stable")
            grouped = length[order]
            first = np.searchsorted(grouped, grouped)
            rank = np.empty(len(row), np.int64)
            rank[order] = seen[grouped] + np.arange(len(row)) - first
            seen += np.bincount(length, minlength=capacity + 1)
            yield table(key=batch.column("key").to_numpy()[row], piece=piece.astype(np.int32), start=start, length=length, ids_crc32=crc, part=np.full(len(row), part, np.int32), rank=rank)

    return docs.select("key", "text").mapInArrow(cut, PIECE)


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    tokenizer = tokenizer or default_path()

    def work(keyed: DataFrame) -> DataFrame:
        cut = keep(cut_pieces(keyed, tokenizer, end, capacity), "pieces")
        shares = cut.groupBy("length", "part").count()
        ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        shares = shares.select("length", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
        histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
        slots = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wide = np.int64(1) << 44
            first = slots[:, 0] * wide + slots[:, 1]
            for b in batches:
                if not b.num_rows:
                    continue
                col = {name: b.column(i).to_numpy() for i, name in enumerate(b.schema.names)}
                rank = col["rank"] + col["ahead"]
                slot = np.searchsorted(first, col["length"] * wide + rank, "right") - 1
                out = {n: col[n] for n in ("key", "piece", "start", "length", "ids_crc32")}
                yield table(**out, sequence_id=slots[slot, 3] + rank - slots[slot, 1], offset=slots[slot, 4])

        return cut.join(shares, ["length", "part"]).select("key", "piece", "start", "length", "ids_crc32", "rank", "ahead").mapInArrow(place, "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

    return by_key(docs, work)
