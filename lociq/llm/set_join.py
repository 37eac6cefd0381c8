"""N-gram Jaccard self-join by universe partitioning.

Every text becomes its set of distinct shingles; equal sets are one entity. Set sizes fall into bands in
which linked partners lie in the same band or the next. In a band whose smaller partner has at most `hi`
shingles, linked sets differ in at most H = floor((100 - t) hi / t) of them (t the threshold in percent).
Shingle hashes are dealt to m segments. By the pigeonhole principle it is enough that a set's allocation
over its segments sums to H + 1: an equal non-empty segment counts 1, a segment indexed with its
one-deletion neighbourhood counts 2 (it matches when it differs in one shingle at most). Segments that
are empty count 0, as their bucket would hold much of the band. m and the number of deletion segments are
chosen per band by expected cost. The few sets whose allocation falls short also count their empty
segments, and only they are joined in those buckets, so no link is lost.

Buckets of up to `whole` sets give all their pairs. Larger buckets first give a star around their
smallest set; after the star's links are verified, only pairs of different components are left to
compare, so a group of near copies costs a row each, not a row a pair. A bucket of more than about `hot` sets
is dealt to cells of that size before anything is shuffled, and its star is made by aggregation, so that no
task reads such a bucket; a sample of the sets, by hash, finds these buckets. It decides where rows go
and nothing else: a hot bucket that it misses is read by one task, with the same result. What is left of a large bucket, and
large buckets of empty segments, are compared in tiles of at most about `tile` by `tile` sets, each a group
of its own, so that no task holds a bucket; only pairs that sizes and sketches allow leave a tile.
Candidate pairs are pruned by size and by an exact bound from parity sketches, then verified on the whole
texts.

Null, empty or wordless text: no shingles, linked with nothing. Very long texts: their sets are made one
text at a time. Ties and repeated rows: rows of one text are linked if not empty, and the smallest doc_id
names them. Null or repeated doc_ids: see by_key. Empty table: empty result. Other columns of the input are
not touched. Shingles and sets are told apart by 64- and 62-bit hashes: among n different ones two share one
with probability of about n^2 / 2^63.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.components import components
from lociq.llm.session import by_key, keep, release
from lociq.llm.text import U64, mix, pieces, row_sums, shingle_sets, signed, table

HOME, NEEDY = U64(1) << U64(63), U64(1) << U64(62)
ENTITY = NEEDY - U64(1)
EMPTY, CELL = U64(1), U64(2)  # the low bits of a bucket id: a bucket of empty segments; a cell of a hot bucket
MOST_HOT = 1_000_000  # hot buckets at most: the largest ones
MOST_BROADCAST = 200_000  # rows a broadcast table of buckets has at most


def bands(largest: int, t: int) -> list[tuple[int, int, int]]:
    """(lo, hi, H) of the size bands up to `largest` shingles."""
    out, lo = [], 1
    while lo <= largest:
        hi = lo * 100 // t
        out.append((lo, hi, (100 - t) * hi // t))
        lo = hi + 1
    return out


def allocate(lo: int, hi: int, h: int, members: int) -> tuple[int, int]:
    """Segments m >= H + 1 and deletion segments K of least expected cost for a band with so many sets.

    Cost: index rows of a set, plus the comparisons caused by sets that must use their empty segments.
    """
    size, best = (lo + hi) / 2, None
    for stretch in (1.0, 1.03, 1.06, 1.1, 1.15, 1.2, 1.3, 1.5, 2.0):
        m = max(h + 1, math.ceil((h + 1) * stretch))
        lam = size / m
        empty, single = math.exp(-lam), lam * math.exp(-lam)
        for k in sorted({0, 1, 2, 3, m // 32, m // 16, m // 8}):
            if k > m:
                continue
            mean = (m - k) * (1 - empty) + k * (2 * (1 - empty - single) + single)
            spread = math.sqrt(max(m * empty * (1 - empty), 1e-9))
            short = 0.5 * math.erfc((mean - h - 0.5) / spread / math.sqrt(2))
            cost = m * (1 - empty) + k * lam + short * m * empty * members * empty
            if best is None or cost < best[0]:
                best = (cost, m, k)
    return best[1], best[2]


def segment_rows(values: np.ndarray, at: np.ndarray, scheme: np.ndarray, m: np.ndarray, k: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids and rows of the sets values[at[i]:at[i+1]] (ascending) under per-row schemes; and the rows that fall short."""
    rows = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(rows), size)
    first = np.concatenate([[0], np.cumsum(m)])
    gid = first[:-1][row] + (((values >> U64(32)) * m[row].astype(U64)) >> U64(32)).astype(np.int64)
    element = mix(values ^ U64(0xA24BAED4963EE407))
    cut = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])) if len(gid) else np.zeros(0, np.int64)
    seg, count = gid[cut], np.diff(np.concatenate([cut, [len(gid)]]))
    total = row_sums(element, np.concatenate([cut, [len(gid)]]))
    owner = row[cut]
    local = seg - first[:-1][owner]

    def bucket(content: np.ndarray, n: np.ndarray, own: np.ndarray, which: np.ndarray) -> np.ndarray:
        place = mix(scheme[own].astype(U64) * U64(0x9E3779B97F4A7C15) + which.astype(U64))
        return mix(mix(content + n.astype(U64) * U64(0xC2B2AE3D27D4EB4F)) ^ place) & ~(EMPTY | CELL)

    near = (local < k[owner]) & (count >= 2)
    full = bucket(total, count, owner, local)
    reached = np.bincount(owner, weights=np.where(near, 2, 1), minlength=rows)
    short = reached < need
    inner = np.repeat(np.arange(len(seg)), count)
    inner_near = near[inner]
    e = inner[inner_near]
    less = bucket(total[e] - element[inner_near], count[e] - 1, owner[e], local[e])
    filled = np.zeros(int(first[-1]), bool)
    filled[seg] = True
    hole = np.flatnonzero(~filled)
    hole_row = np.searchsorted(first, hole, "right") - 1
    hole_local = hole - first[:-1][hole_row]
    holes = bucket(np.zeros(len(hole), U64), np.zeros(len(hole), np.int64), hole_row, hole_local) | EMPTY
    return np.concatenate([full, less, holes]), np.concatenate([owner, owner[e], hole_row]), short


def _identity(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 62-bit name of each set."""
    return mix(row_sums(mix(values ^ U64(0x8CB92BA72F3D8DD7)), at) + np.diff(at).astype(U64)) & ENTITY


def describe(docs: DataFrame, width: int) -> DataFrame:
    """(key, n, entity, sketch): set size, the set's name, and its parity sketch of four to eight bits a shingle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches):
            values, at = shingle_sets(data, offs, width)
            n = np.diff(at)
            bits = 1 << np.ceil(np.log2(np.maximum(4 * n, 64))).astype(np.int64)
            place = np.concatenate([[0], np.cumsum(bits)])
            row = np.repeat(np.arange(len(n)), n)
            odd = np.bincount(place[:-1][row] + (mix(values) & (bits[row] - 1).astype(U64)).astype(np.int64), minlength=int(place[-1])) & 1
            packed = np.packbits(odd.astype(bool), bitorder="little")
            sketch = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((place // 8).astype(np.int32)), pa.py_buffer(packed)])
            yield table(key=batch.column("key"), n=n, entity=signed(_identity(values, at)), sketch=sketch)

    return docs.select("key", "text").mapInArrow(work, "key long, n long, entity long, sketch binary")


@dataclass
class Hot:
    """Hot buckets (ascending ids) and their numbers of cells."""

    names: np.ndarray
    cells: np.ndarray

    @staticmethod
    def _cell(bucket: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix(bucket ^ mix(salt + U64(1))) & ~(EMPTY | CELL) | bucket & EMPTY | CELL

    def deal(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Bucket ids, those of hot buckets replaced by their cells. A set lies in one cell of a bucket."""
        if not len(self.names) or not len(bucket):
            return bucket
        at = np.minimum(np.searchsorted(self.names, bucket), len(self.names) - 1)
        hit = np.flatnonzero(self.names[at] == bucket)
        bucket[hit] = self._cell(bucket[hit], mix(tag[hit] & ENTITY) % self.cells[at[hit]].astype(U64))
        return bucket

    def all_cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cells, ascending, and their buckets."""
        bucket = np.repeat(self.names, self.cells)
        salt = np.arange(len(bucket)) - np.repeat(np.cumsum(self.cells) - self.cells, self.cells)
        cell = self._cell(bucket, salt.astype(U64))
        order = np.argsort(cell)
        return cell[order], bucket[order]


NONE_HOT = Hot(np.zeros(0, U64), np.zeros(0, np.int64))


def find_hot(docs: DataFrame, width: int, plan: list[tuple[int, int, int, int, int]], hot: int) -> Hot:
    """The buckets of more than about `hot` sets, from the sets of the texts whose hash is divisible by up to 64; the MOST_HOT largest of them.

    At most MOST_HOT rows reach the driver, and every bucket that is left out holds less than that part of the index.
    """
    rate = max(1, min(64, hot // 500))
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(rate)) == 0)
    counted = index_rows(some, width, plan, NONE_HOT).distinct().groupBy("bucket").agg((F.count("*") * rate).alias("n")).filter(F.col("n") > hot)
    rows = counted.orderBy(F.desc("n"), "bucket").limit(MOST_HOT).toArrow()
    names, n = rows.column("bucket").to_numpy().view(U64), rows.column("n").to_numpy()
    order = np.argsort(names)
    return Hot(names[order], -(-n[order] // hot))


def index_rows(docs: DataFrame, width: int, plan: list[tuple[int, int, int, int, int]], hot: Hot) -> DataFrame:
    """(bucket, tag): each set under its own band's scheme, and as the larger partner under the scheme below; hot buckets by cell."""
    lo = np.array([p[0] for p in plan])
    need, m, k = (np.array([p[i] for p in plan]) for i in (2, 3, 4))
    need = need + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets this task has indexed: copies within a task cost nothing more
        for _, data, offs in pieces(batches):
            values, at = shingle_sets(data, offs, width)
            names = _identity(values, at)
            n = np.diff(at)
            fresh = np.zeros(len(n), bool)
            for i, name in enumerate(names.tolist()):
                if n[i] and name not in seen:
                    seen.add(name)
                    fresh[i] = True
            if len(seen) > 1 << 21:
                seen.clear()
            if not fresh.any():
                continue
            values, names, n = values[np.repeat(fresh, n)], names[fresh], n[fresh]
            at = np.concatenate([[0], np.cumsum(n)])
            own = np.searchsorted(lo, n, "right") - 1
            for guest in (0, 1):
                scheme = own - guest
                ok = (scheme >= 0) & (need[scheme] > 1)  # different sets cannot be linked where H is 0
                if not ok.any():
                    continue
                v, a = values[np.repeat(ok, n)], np.concatenate([[0], np.cumsum(n[ok])])
                s = scheme[ok]
                ids, row, short = segment_rows(v, a, s, m[s], k[s], need[s])
                tag = (names[ok] | (U64(0) if guest else HOME) | np.where(short, NEEDY, U64(0)))[row]
                yield table(bucket=signed(hot.deal(ids, tag)), tag=signed(tag))

    return docs.select("text").mapInArrow(work, "bucket long, tag long")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of batches sorted by key, cut so that no key is split."""
    held: dict[str, list[np.ndarray]] = {}
    for b in batches:
        if not b.num_rows:
            continue
        col = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        last = int(np.searchsorted(col[key], col[key][-1], "left"))
        if last:
            yield {n: np.concatenate([*held.get(n, []), v[:last]]) for n, v in col.items()}
            held = {n: [v[last:]] for n, v in col.items()}
        elif held and held[key][0][0] != col[key][0]:
            yield {n: np.concatenate(v) for n, v in held.items()}
            held = {n: [v] for n, v in col.items()}
        else:
            for n, v in col.items():
                held.setdefault(n, []).append(v)
    if held:
        yield {n: np.concatenate(v) for n, v in held.items()}


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = a & ENTITY, b & ENTITY
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    both = np.unique(np.stack([lo, hi], 1)[lo != hi], axis=0) if len(lo) < 1_000_000 else np.stack([lo, hi], 1)[lo != hi]
    return both[:, 0], both[:, 1]


def candidates(index: DataFrame, whole: int, hot: Hot) -> DataFrame:
    """(kind, a, b): kind 0 a pair to compare, kind 1 the tag b as a member of the large bucket a, kind 2 of the hot bucket a."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, bucket_of = hot.all_cells()
        for run in _runs(batches, "bucket"):
            bucket, tag = run["bucket"].view(U64), run["tag"].view(U64)
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (tag[1:] != tag[:-1])])  # copies from other tasks
            bucket, tag = bucket[new], tag[new]
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            size = np.diff(np.concatenate([start, [len(bucket)]]))
            home = (tag & HOME) > 0
            # Signed order puts a bucket's home sets first; a bucket of guests only is compared under their own scheme.
            in_cells = (bucket[start] & CELL) > 0
            live = (size > 1) & home[start] & ~in_cells
            empty = (bucket[start] & EMPTY) > 0
            left, right, members, hot_members = [], [], [], []
            for g in np.flatnonzero(in_cells).tolist():
                s, n = int(start[g]), int(size[g])
                hot_members.append((np.full(n, bucket_of[np.searchsorted(cells, bucket[s])]), tag[s : s + n]))
            for step in range(1, min(whole, int(size.max()))):  # all pairs of small buckets, by distance
                pick = live & ~empty & (size <= whole) & (size > step)
                n = size[pick] - step
                i = np.repeat(start[pick], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                i = i[home[i]]
                left.append(tag[i])
                right.append(tag[i + step])
            big = np.flatnonzero(live & ~empty & (size > whole))
            for g in big.tolist():
                s, n = int(start[g]), int(size[g])
                left.append(np.full(n - 1, tag[s]))
                right.append(tag[s + 1 : s + n])
                members.append((np.full(n, bucket[s]), tag[s : s + n]))
            needy = (tag & NEEDY) > 0
            for g in np.flatnonzero(live & empty & (np.logical_or.reduceat(needy, start))).tolist():
                s, n = int(start[g]), int(size[g])
                if n > whole:
                    members.append((np.full(n, bucket[s]), tag[s : s + n]))
                    continue
                for i in np.flatnonzero(needy[s : s + n]).tolist():
                    use = home[s : s + n] | home[s + i]
                    right.append(tag[s : s + n][use])
                    left.append(np.full(int(use.sum()), tag[s + i]))
            if left:
                a, b = _pairs(np.concatenate(left), np.concatenate(right))
                for lo in range(0, len(a), 200_000):
                    yield table(kind=np.zeros(len(a[lo : lo + 200_000]), np.int32), a=signed(a[lo : lo + 200_000]), b=signed(b[lo : lo + 200_000]))
            for kind, rows in ((1, members), (2, hot_members)):
                for where, tags in rows:
                    yield table(kind=np.full(len(tags), kind, np.int32), a=signed(where), b=signed(tags))

    return index.repartition("bucket").sortWithinPartitions("bucket", "tag").mapInArrow(work, "kind int, a long, b long")


def hot_stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the smallest set that is at home in each hot bucket (bucket, tag) of non-empty segments with all others there."""
    full = members.filter(F.col("bucket").bitwiseAND(int(EMPTY)) == 0)
    middle = full.groupBy("bucket").agg(F.min("tag").alias("middle")).filter("middle < 0")  # tags at home are negative; MOST_HOT rows at most
    own, other = F.col("middle").bitwiseAND(int(ENTITY)), F.col("tag").bitwiseAND(int(ENTITY))
    return full.join(middle, "bucket").select(F.least(own, other).alias("a"), F.greatest(own, other).alias("b")).filter("a <> b")


def _widths(width: np.ndarray, sketch: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By sketch width in words: the sets at least that wide, and their sketches folded to it."""
    out = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width >= w)
        out[w] = at, np.stack([np.bitwise_xor.reduce(np.frombuffer(sketch[i], U64).reshape(-1, w), axis=0) for i in at.tolist()])
    return out


def crowded(placed: DataFrame, entities: DataFrame, tile: int) -> DataFrame:
    """Members (bucket, tag, entity, component) of the large buckets that hold several components, with n, sketch and how their bucket
    is tiled: first marks the sets that are compared with all others (those outside the largest component; in the buckets of empty
    segments those that fall short), in `rows` tiles, and all sets stand in `columns` tiles."""
    needy = F.col("tag").bitwiseAND(int(NEEDY)) != 0
    shares = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(needy.cast("long")).alias("needy"))
    sizes = shares.groupBy("bucket").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main"), F.sum("needy").alias("needy"), F.count("*").alias("several")).filter("several > 1")
    empty = F.col("bucket").bitwiseAND(int(EMPTY)) != 0
    sizes = sizes.filter(~empty | (F.col("needy") > 0))  # nothing is compared where no set falls short
    firsts = F.when(empty, F.col("needy")).otherwise(F.col("size") - F.col("main.n"))
    sizes = keep(sizes.select("bucket", F.col("main.component").alias("main"), F.greatest(F.ceil(firsts / tile), F.lit(1)).alias("rows"), F.ceil(F.col("size") / tile).alias("columns")), "crowded")
    few = sizes.count() <= MOST_BROADCAST  # else a shuffle by bucket, whose large keys the adaptive plan splits
    joined = placed.join(F.broadcast(sizes) if few else sizes, "bucket").join(entities.select("entity", "n", "sketch"), "entity")
    return joined.select("bucket", "tag", "component", "n", "sketch", "rows", "columns", F.when(empty, needy).otherwise(F.col("component") != F.col("main")).alias("first"))


def cross_pairs(members: DataFrame, t: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different components within each large bucket that sizes and sketches allow.

    nearest: of each set that is compared with all others, only the pair whose sketches are least apart.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "cell"):
            edge = np.flatnonzero(np.concatenate([[True], run["cell"][1:] != run["cell"][:-1]])).tolist()
            found: dict[str, list[np.ndarray]] = {c: [] for c in ("bucket", "own", "other", "gap")}
            for s, e in zip(edge, [*edge[1:], len(run["cell"])]):
                side = run["side"][s:e]
                tag, comp, n, first = run["tag"][s:e].view(U64), run["component"][s:e], run["n"][s:e], run["first"][s:e].astype(bool)
                home, sketches = (tag & HOME) > 0, run["sketch"][s:e].tolist()
                width = np.array([len(x) // 8 for x in sketches])
                by_width = _widths(width, sketches)
                for i in np.flatnonzero(side == 0).tolist():
                    use = (side == 1) & (comp != comp[i]) & (home | home[i])
                    if not nearest:
                        use &= ~first | (tag > tag[i])  # two sets that are both compared with all meet once
                    use &= np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * t
                    close, gaps = [], []
                    for w, (at, folded) in by_width.items():
                        if w > width[i]:
                            continue
                        pick = use[at] if w == width[i] else use[at] & (width[at] == w)
                        j = at[pick]
                        apart = np.bitwise_count(folded[pick] ^ folded[np.searchsorted(at, i)]).sum(1)
                        ok = apart <= (100 - t) * (n[i] + n[j]) // (100 + t)
                        close.append(j[ok])
                        gaps.append(apart[ok] / (n[i] + n[j[ok]]))
                    j, gap = np.concatenate(close), np.concatenate(gaps)
                    if nearest and len(j):
                        j, gap = j[[gap.argmin()]], gap[[gap.argmin()]]
                    for c, x in (("bucket", np.full(len(j), run["bucket"][s])), ("own", np.full(len(j), tag[i])), ("other", tag[j]), ("gap", gap)):
                        found[c].append(x)
            out = {c: np.concatenate(v) for c, v in found.items() if v}
            if out and len(out["gap"]):
                yield table(bucket=out["bucket"], own=signed(out["own"]), other=signed(out["other"]), gap=out["gap"])

    tile_of = lambda n: F.pmod(F.xxhash64("tag"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sides = [members.filter("first").select("*", F.lit(0).alias("side"), tile_of("rows").alias("row"), every("columns").alias("column")), members.select("*", F.lit(1).alias("side"), tile_of("columns").alias("column"), every("rows").alias("row"))]
    cells = sides[0].unionByName(sides[1]).select(F.xxhash64("bucket", "row", "column").alias("cell"), "bucket", "side", "tag", "component", "n", "first", "sketch")
    found = cells.repartition("cell").sortWithinPartitions("cell", "bucket").mapInArrow(work, "bucket long, own long, other long, gap double")
    if nearest:
        found = found.groupBy("bucket", "own").agg(F.min_by("other", F.struct("gap", "other")).alias("other"))
    a, b = F.col("own").bitwiseAND(int(ENTITY)), F.col("other").bitwiseAND(int(ENTITY))
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()


def prune(pairs: DataFrame, entities: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) that sizes and parity sketches allow; sketches bound the symmetric difference from below."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * t
            most = (100 - t) * (na + nb) // (100 + t)
            sa, sb = batch.column("sa"), batch.column("sb")
            for i in np.flatnonzero(ok).tolist():
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (sa, sb))
                if len(x) != len(y):
                    if len(x) < len(y):
                        x, y = y, x
                    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
                ok[i] = int(np.bitwise_count(x ^ y).sum()) <= most[i]
            if ok.any():
                yield table(a=batch.column("a").filter(pa.array(ok)), b=batch.column("b").filter(pa.array(ok)))

    first, second = (entities.select(F.col("entity").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in ("a", "b"))
    joined = pairs.join(first, "a").filter("na > 0").join(second, "b").filter(f"least(na, nb) * 100 >= greatest(na, nb) * {t}")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(work, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, width: int, t: int) -> DataFrame:
    """Pairs (a, b) whose whole texts (entity, text) have 100 * intersection >= t * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches, "ta", 1 << 20):
            xv, xat = shingle_sets(data, offs, width)
            other = next(pieces(iter([batch]), "tb", 1 << 60))
            yv, yat = shingle_sets(other[1], other[2], width)
            nx, ny = np.diff(xat), np.diff(yat)
            owner = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
            values = np.concatenate([xv, yv])
            order = np.lexsort((values, owner))
            values, owner = values[order], owner[order]
            same = np.flatnonzero((values[1:] == values[:-1]) & (owner[1:] == owner[:-1]))
            both = np.bincount(owner[same], minlength=len(nx))
            ok = pa.array(100 * both >= t * (nx + ny - both))
            yield table(a=batch.column("a").filter(ok), b=batch.column("b").filter(ok))

    first, second = (texts.select(F.col("entity").alias(x), F.col("text").alias(f"t{x}")) for x in ("a", "b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def set_links(docs: DataFrame, width: int = 4, t: int = 85, whole: int = 8, tile: int = 1024, hot: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The described documents (key, n, entity), verified links (a, b) that connect all linked entities, and the components (entity, component) they make."""
    described = keep(describe(docs, width), "sets")
    entities = keep(described.filter("n > 0").groupBy("entity").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "entities")
    largest = entities.agg(F.max("n")).first()[0] or 0
    plan = bands(largest, t)
    edges = F.array(*[F.lit(lo) for lo, _, _ in plan]) if plan else F.array(F.lit(1))
    held = {r["band"]: r["count"] for r in entities.groupBy(F.size(F.filter(edges, lambda x: x <= F.col("n"))).alias("band")).count().collect()}  # a row a band
    plan = [(*p, *allocate(*p, held.get(i + 1, 0))) for i, p in enumerate(plan)]
    crowds = find_hot(docs, width, plan, hot)
    found = keep(candidates(index_rows(docs, width, plan, crowds), whole, crowds), "candidates")
    near = found.filter("kind = 0").select("a", "b")
    if len(crowds.names):
        near = near.unionByName(hot_stars(found.filter("kind = 2").select(F.col("a").alias("bucket"), F.col("b").alias("tag"))))
    pairs = keep(prune(near.distinct(), entities, t), "pairs")
    members = found.filter("kind > 0").select(F.col("a").alias("bucket"), F.col("b").alias("tag"), F.col("b").bitwiseAND(int(ENTITY)).alias("entity"))
    wanted = pairs.select(F.col("a").alias("entity")).union(pairs.select("b")).union(members.select("entity")).distinct()
    wanted = entities.join(wanted, "entity").select("entity", "key")
    texts = keep(docs.select("key", "text").join(wanted, "key").select("entity", "text"), "texts")
    links = keep(verify(pairs, texts, width, t), "links")
    tables, apart = [entities, found, texts, pairs], None
    placed_by = components(links).withColumnRenamed("node", "entity")
    if not members.isEmpty():
        # Sets that a star left apart first try their nearest neighbour of another component, twice; what is
        # still apart then is compared in full. Without a new link the nearest neighbours would be the same again.
        for nearest in (True, True, False):
            if nearest and apart is not None:
                continue
            if apart is None:
                placed = keep(members.join(placed_by, "entity", "left").select("bucket", "tag", "entity", F.coalesce("component", "entity").alias("component")), "placed")
                apart = keep(crowded(placed, entities, tile), "apart")
                release(placed)
            more = keep(cross_pairs(apart, t, nearest).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
            new = keep(verify(more, texts, width, t), "more-links")
            pairs = pairs.union(more)
            tables.append(more)
            if not new.isEmpty():
                links = links.union(new)
                placed_by = components(links).withColumnRenamed("node", "entity")
                release(apart)
                apart = None
    release(*tables, *([] if apart is None else [apart]))
    return described.drop("sketch"), links, placed_by


def _grouped(keyed: DataFrame, width: int, t: int, whole: int, tile: int, hot: int) -> DataFrame:
    """(key, n_shingles, component_id) of documents with unique keys."""
    described, links, placed_by = set_links(keyed, width, t, whole, tile, hot)
    joined = described.join(placed_by, "entity", "left")
    named = keep(joined.select("key", "n", F.when(F.col("n") > 0, F.coalesce("component", "entity")).alias("component")), "components")
    release(described, links)
    least = named.filter("n > 0").groupBy("component").agg(F.min("key").alias("component_id"))
    return named.join(least, "component", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def near_groups(docs: DataFrame, width: int = 4, t: int = 85, whole: int = 8, tile: int = 1024, hot: int = 50_000) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return by_key(docs, lambda keyed: _grouped(keyed, width, t, whole, tile, hot), ("component_id",))


def drop_near_copies(docs: DataFrame, width: int = 5, t: int = 80, whole: int = 8, tile: int = 1024, hot: int = 50_000) -> DataFrame:
    """The rows of docs that lead their group, with the columns of docs.

    The verdict is that of the row: among rows of one id, or without an id, each is judged by its own text (see by_key).
    """

    def work(keyed: DataFrame) -> DataFrame:
        leads = _grouped(keyed.select("key", "text", "id_text"), width, t, whole, tile, hot).filter("key = component_id").select("key")
        return keyed.select("key", F.when(~F.col("_void"), F.col("text")).alias("text"), "_rest").join(leads, "key", "left_semi")

    kept = by_key(docs, work, carry=True)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
