"""Repeated passages: every byte covered by a string of `length` bytes that also starts earlier.

A full suffix array of a corpus does not fit one machine, so suffixes are sampled by content: each window
of `length` bytes belongs to the smallest 16-byte gram hash in it (its anchor), and equal windows have
equal anchors at equal distances. A document falls into segments, runs of windows with one anchor.

1. Of segments equal in all their bytes, all but the earliest repeat. A task settles this for the segments
   it has itself, so that a passage sends on about one row a task; the rows left are dealt and sorted by
   anchor and content, which streams. Anchors that stand in different segments are repeats that end
   nearby, and one occurrence of each such segment goes on.
2. Their contexts are dealt by anchor and sorted by the bytes that follow: the part of the enhanced
   suffix array that lies at the anchor. A stack scan over common-prefix lengths gives the tree of
   intervals (repeats that cannot grow to the right). In each interval the bytes before the anchor are
   sorted and scanned in the same way, so intervals of both scans are repeats whose next bytes differ on
   either side: maximal repeats, with all their occurrences. All but the earliest are removed.

An anchor with more than `most` segments is handled exactly without the tree: its windows are dealt by
their own contents, and all but the earliest of each repeat, in constant memory.

Positions are judged on the input, and matches never cross documents. Equal bytes are told by two 64-bit
hashes of different kinds: among n segments two different ones are taken for equal with probability of about
n^2 / 2^129. The intervals of step 2 compare the bytes themselves. Null text counts as empty. Very long texts:
their segments stream; a text is held whole by the one task that reads it. Ties: the smaller doc_id, then the
earlier start. Null or repeated doc_ids: see by_key. Empty table: empty result. Other columns of the input are
not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lociq.llm.session import by_key, keep
from lociq.llm.set_join import _runs
from lociq.llm.text import U64, mix, pieces, signed, span_hash, table

GRAM = 16
LONGEST = 4000  # a segment's windows and its anchor's distance each fit in twelve bits


def segments(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, two content hashes, row, first window, number of windows and anchor distance of all segments."""
    n = len(data)
    width = length - GRAM + 1
    none = tuple(np.zeros(0, t) for t in (U64, U64, U64, np.int64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    h = mix(view[: n - GRAM + 1] * U64(0x9E3779B97F4A7C15) + mix(view[8 : n - GRAM + 9] + U64(0x632BE59BD9B4E019)))
    low = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    span = 1
    while 2 * span <= width:  # minima of ever wider windows; the low half of a minimum is its leftmost place
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & U64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    valid = np.flatnonzero(offs[1:][row[: len(place)]] - np.arange(len(place)) >= length)
    if not len(valid):
        return none
    place = place[valid]
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    start, count, anchor = valid[cut], np.diff(np.concatenate([cut, [len(valid)]])), place[cut]
    grams = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h), dtype=U64)])  # the second hash: the sum of a segment's gram hashes
    return h[anchor], span_hash(data, start, count + length - 1), grams[start + count + length - GRAM] - grams[start], row[start], start, count, anchor - start


def _pack(start: np.ndarray, count: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return (start << 24) | (count << 12) | distance


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, (at >> 12) & 4095, at & 4095


SEGMENT = "deal long, again boolean, anchor long, content long, grams long, key long, at long"


class _Earliest:
    """The earliest segment of each content that a task has met; at most about `most` contents, those met again kept longest."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.name, self.grams, self.key, self.at, self.met = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def later(self, name: np.ndarray, grams: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of these segments stand behind an equal one: of this run, or of an earlier run."""
        order = np.lexsort((at, key, grams, name))
        x, g = name[order], grams[order]
        first = np.concatenate([[True], (x[1:] != x[:-1]) | (g[1:] != g[:-1])])
        out = np.empty(len(name), bool)
        out[order] = ~first
        lead = order[first]
        if len(lead) > 1:  # of contents that share the first hash, only one is remembered
            lead = lead[np.concatenate([[True], name[lead[1:]] != name[lead[:-1]]])]
        place = np.searchsorted(self.name, name[lead])
        known = place < len(self.name)
        known[known] = (self.name[place[known]] == name[lead[known]]) & (self.grams[place[known]] == grams[lead[known]])
        k, old = lead[known], place[known]
        behind = (self.key[old] < key[k]) | (self.key[old] == key[k]) & (self.at[old] < at[k])
        out[k[behind]] = True
        self.met[old] = True
        ahead = old[~behind]
        self.key[ahead], self.at[ahead] = key[k[~behind]], at[k[~behind]]
        new, to = lead[~known], place[~known]
        if len(new):
            fresh = np.ones(len(new), bool)
            inside = to < len(self.name)
            fresh[inside] = self.name[to[inside]] != name[new[inside]]
            new, to = new[fresh], to[fresh]
            self.name, self.grams, self.key, self.at, self.met = (np.insert(o, to, v) for o, v in ((self.name, name[new]), (self.grams, grams[new]), (self.key, key[new]), (self.at, at[new]), (self.met, False)))
        if len(self.name) > self.most:
            stay = self.met if self.met.sum() <= self.most // 2 else np.zeros(len(self.met), bool)
            self.name, self.grams, self.key, self.at, self.met = (o[stay] for o in (self.name, self.grams, self.key, self.at, np.zeros(len(self.met), bool)))
        return out


def _dealt(seen: _Earliest, anchor: np.ndarray, content: np.ndarray, grams: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of SEGMENT; those that repeat an earlier one of this task are dealt by document, the others by anchor."""
    again = seen.later(content ^ mix(anchor), grams, key, at)
    return table(deal=np.where(again, key, signed(anchor)), again=again, anchor=signed(anchor), content=signed(content), grams=signed(grams), key=key, at=at)


def index_segments(docs: DataFrame, length: int) -> DataFrame:
    """Rows of SEGMENT for every segment of docs (key, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Earliest()
        for batch, data, offs in pieces(batches, most=1 << 20):
            anchor, content, grams, row, start, count, distance = segments(data, offs, length)
            if len(row):
                yield _dealt(seen, anchor, content, grams, batch.column("key").to_numpy()[row], _pack(start - offs[row], count, distance))

    return docs.select("key", "text").mapInArrow(work, SEGMENT)


def split_repeats(index: DataFrame) -> DataFrame:
    """(kind, anchor, key, at): kind 0 for all but the earliest of equal segments, kind 1 for the earliest of
    each segment whose anchor has several. Reads rows in order and keeps one of them in mind."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (anchor, content, grams) of the row before
        held, several = None, False  # the last earliest row, and whether its anchor had one before it
        for b in batches:
            again, anchor, content, grams, key, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            if again.any():
                yield table(kind=np.zeros(int(again.sum()), np.int32), anchor=anchor[again], key=key[again], at=at[again])
                anchor, content, grams, key, at = (x[~again] for x in (anchor, content, grams, key, at))
            if not len(anchor):
                continue
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (grams[1:] != grams[:-1])
            new[0] = last != (anchor[0], content[0], grams[0])
            last = (anchor[-1], content[-1], grams[-1])
            again = np.flatnonzero(~new)
            if len(again):
                yield table(kind=np.zeros(len(again), np.int32), anchor=anchor[again], key=key[again], at=at[again])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            a, k, p = anchor[first], key[first], at[first]
            if held:
                a, k, p = (np.concatenate([[x], y]) for x, y in zip(held, (a, k, p)))
            like_next = a[1:] == a[:-1]
            use = np.zeros(len(a), bool)
            use[:-1] |= like_next
            use[1:] |= like_next
            use[0] |= several and held is not None
            held, several = (a[-1], k[-1], p[-1]), bool(use[-1])
            use[-1] = False
            if use.any():
                yield table(kind=np.ones(int(use.sum()), np.int32), anchor=a[use], key=k[use], at=p[use])
        if held and several:
            yield table(kind=np.ones(1, np.int32), anchor=np.array([held[0]]), key=np.array([held[1]]), at=np.array([held[2]]))

    dealt = index.repartition("deal").drop("deal").sortWithinPartitions("again", "anchor", "content", "grams", "key", "at")
    return dealt.mapInArrow(work, "kind int, anchor long, key long, at long")


def contexts(docs: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """(anchor, key, at, before, after): the bytes before the anchor, backwards, and from it on, of marked segments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches, most=1 << 20):
            found = batch.column("found")
            per = np.diff(found.offsets.to_numpy())
            inner = found.flatten()
            at = inner.field("at").to_numpy()
            start, count, distance = _unpack(at)
            row = np.repeat(np.arange(len(per)), per)
            raw = data.tobytes()
            lo = offs[:-1][row] + start
            mid, hi = lo + distance, lo + count + length - 1
            before = [raw[s:m][::-1] for s, m in zip(lo.tolist(), mid.tolist())]
            after = [raw[m:e] for m, e in zip(mid.tolist(), hi.tolist())]
            yield table(anchor=inner.field("anchor"), key=batch.column("key").to_numpy()[row], at=at, before=pa.array(before, pa.binary()), after=pa.array(after, pa.binary()))

    grouped = marked.groupBy("key").agg(F.collect_list(F.struct("anchor", "at")).alias("found"))  # at most one a byte of the document
    return docs.join(grouped, "key").select("key", "text", "found").mapInArrow(work, "anchor long, key long, at long, before binary, after binary")


def intervals(lcp: list[int], least: int | list[int]) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals, by a stack scan. lcp[i] is that of i - 1 and i, negative where a group begins."""
    out, stack = [], []
    for i, depth in enumerate([*lcp, -1]):
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            out.append((top, first, i - 1))
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    if isinstance(least, int):
        return [x for x in out if x[0] >= least]
    return [x for x in out if x[0] >= least[x[1]]]


def _padded(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes padded with 0xFF, which no UTF-8 text holds, and their lengths."""
    joined = b"".join([x.ljust(width, b"\xff") for x in column])
    return np.frombuffer(joined, np.uint8).reshape(len(column), width), np.array([len(x) for x in column], np.int64)


def _shared(rows: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of rows i and j."""
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), 1 << 15):
        a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
        differ = rows[a] != rows[b]
        out[lo : lo + len(a)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(out, np.minimum(size[i], size[j]))


def _members(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first..last of every interval, and the interval of each."""
    n = last - first + 1
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[which], which


def maximal_repeats(group: np.ndarray, before: list[bytes], after: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of `length` bytes or more around the anchors, from contexts sorted by (group, after).

    Returns for every occurrence: the repeat's number, the context's row, and the bytes it takes before and from the anchor.
    """
    tail, tail_size = _padded(after, length)
    head, head_size = _padded(before, length - GRAM)
    lcp = _shared(tail, tail_size, np.arange(len(group) - 1), np.arange(1, len(group)))
    lcp[group[1:] != group[:-1]] = -1
    right = np.array(intervals([-1, *lcp.tolist()], GRAM), np.int64).reshape(-1, 3)
    row, which = _members(right[:, 1], right[:, 2])
    rank = np.empty(len(group), np.int64)
    rank[np.argsort(np.ascontiguousarray(head).view(f"S{head.shape[1]}").ravel(), kind="stable")] = np.arange(len(group))
    order = np.lexsort((rank[row], which))
    row, which = row[order], which[order]
    back = _shared(head, head_size, row[:-1], row[1:]) if len(row) else np.zeros(0, np.int64)
    back[which[1:] != which[:-1]] = -1
    need = np.maximum(length - right[which, 0], 0)
    left = np.array(intervals([-1, *back.tolist()], need.tolist()), np.int64).reshape(-1, 3)
    place, number = _members(left[:, 1], left[:, 2])
    return number, row[place], left[number, 0], right[which[place], 0]


def removed_around_anchors(found: DataFrame, length: int) -> DataFrame:
    """(key, start, size): the spans that all but the earliest occurrence of each maximal repeat lose."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "anchor"):
            if len(run["anchor"]) < 2:
                continue
            start, count, distance = _unpack(run["at"])
            number, row, head, tail = maximal_repeats(run["anchor"], run["before"].tolist(), run["after"].tolist(), length)
            if not len(row):
                continue
            age = np.empty(len(start), np.int64)
            age[np.lexsort((start, run["key"]))] = np.arange(len(start))
            edge = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            oldest = np.minimum.reduceat(age[row], edge)
            # Only windows of this anchor are judged here: those that start lo..hi bytes before it.
            lo = np.maximum(length - tail, distance[row] - count[row] + 1)
            hi = np.minimum(head, distance[row])
            use = (age[row] != oldest[number]) & (lo <= hi)
            if use.any():
                # Every such span holds the anchor, so those of one context make one span.
                order = np.argsort(row[use], kind="stable")
                r = row[use][order]
                edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                far, near = np.maximum.reduceat(hi[use][order], edge), np.minimum.reduceat(lo[use][order], edge)
                r = r[edge]
                spans = np.stack([run["key"][r], start[r] + distance[r] - far, far - near + length], 1)
                yield table(key=spans[:, 0], start=spans[:, 1], size=spans[:, 2])

    return found.repartition("anchor").sortWithinPartitions("anchor", "after").mapInArrow(work, "key long, start long, size long")


def single_windows(found: DataFrame, length: int) -> DataFrame:
    """Contexts as segments of one window each, dealt by content: for anchors with very many segments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Earliest()
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                part = b.slice(lo, 4000)
                start, count, distance = _unpack(part.column("at").to_numpy())
                texts = [x[::-1] + y for x, y in zip(part.column("before").to_pylist(), part.column("after").to_pylist())]
                data = np.frombuffer(b"".join(texts), np.uint8)
                base = np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]]).astype(np.int64)
                row = np.repeat(np.arange(len(count)), count)
                step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                content = span_hash(data, base[row] + step, np.full(len(row), length))
                other = span_hash(255 - data, base[row] + step, np.full(len(row), length))
                yield _dealt(seen, content, content, other, part.column("key").to_numpy()[row], _pack(start[row] + step, np.ones(len(row), np.int64), np.zeros(len(row), np.int64)))

    return found.mapInArrow(work, SEGMENT)


def removed_spans(docs: DataFrame, length: int = 100, most: int = 20_000) -> DataFrame:
    """(key, start, size): spans of docs (key, text) whose windows all start earlier too; they may overlap."""
    if not GRAM <= length <= LONGEST:
        raise ValueError(f"length must be {GRAM} to {LONGEST}")
    found = keep(split_repeats(index_segments(docs, length)), "segments")
    at = F.col("at")
    whole = [F.shiftright(at, 24).alias("start"), (F.shiftright(at, 12).bitwiseAND(4095) + (length - 1)).alias("size")]
    spans = found.filter("kind = 0").select("key", *whole)
    marked = found.filter("kind = 1").select("anchor", "key", "at")
    crowded = keep(marked.groupBy("anchor").count().filter(F.col("count") > most).select("anchor"), "crowded")
    if crowded.isEmpty():
        return spans.union(removed_around_anchors(contexts(docs, marked, length), length))
    few = contexts(docs, marked.join(crowded, "anchor", "left_anti"), length)
    many = contexts(docs, marked.join(crowded, "anchor", "left_semi"), length)
    again = split_repeats(single_windows(many, length)).filter("kind = 0").select("key", *whole)
    return spans.union(removed_around_anchors(few, length)).union(again)


def _cut(docs: DataFrame, spans: DataFrame, text: bool) -> DataFrame:
    per = spans.groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches):
            gone = np.zeros(len(data) + 1, np.int64)
            found = batch.column("spans")
            per_row = np.diff(found.offsets.to_numpy())
            inner = found.flatten()
            if len(inner):
                base = np.repeat(offs[:-1], per_row)
                start, size = inner.field("start").to_numpy(), inner.field("size").to_numpy()
                np.add.at(gone, base + start, 1)
                np.add.at(gone, base + start + size, -1)
            gone = np.cumsum(gone)[:-1] > 0
            if text and len(data):  # a character of which bytes stay stays whole
                head = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, head), np.diff(np.concatenate([head, [len(data)]])))
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            opens = gone.copy()
            opens[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
            rows = len(offs) - 1
            kept = data[~gone].tobytes()
            left = np.concatenate([[0], np.cumsum(np.bincount(row[~gone], minlength=rows))]).tolist()
            parts = [kept[s:e] for s, e in zip(left[:-1], left[1:])]
            out = {"key": batch.column("key"), "n_bytes": np.diff(offs), "n_removed": np.bincount(row[gone], minlength=rows), "n_spans": np.bincount(row[opens], minlength=rows)}
            if text:
                yield pa.RecordBatch.from_arrays([out["key"], batch.column("_rest"), pa.array([x.decode("utf-8", "replace") for x in parts], pa.string())], schema=to_arrow_schema(shape))
            else:
                yield table(**out, kept_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()))

    joined = docs.join(per, "key", "left").select("key", "text", *(["_rest"] if text else []), F.coalesce("spans", F.array().cast("array<struct<start:bigint,size:bigint>>")).alias("spans"))
    shape = joined.select("key", "_rest", "text").schema if text else "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(work, shape)


def repeat_report(docs: DataFrame, length: int = 100, most: int = 20_000) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    return by_key(docs, lambda keyed: _cut(keyed, removed_spans(keyed, length, most), False))


def cut_repeats(docs: DataFrame, length: int = 100, most: int = 20_000) -> DataFrame:
    """docs with repeated passages cut from their texts, and n_chars, where it is a column, counted anew.

    A character that loses only some of its bytes stays. Documents stay even if little text is left.
    """
    out = by_key(docs, lambda keyed: _cut(keyed, removed_spans(keyed, length, most), True), carry=True)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
