"""Brown class-based bigram language model, by exchange clustering.

Words fall into classes; a word's probability is that of its class after the class before it, times the
word's share of its class. Classes are found by exchange over the whole vocabulary:

1. Texts are coded once: a block is a run of some millions of tokens, with its own word list, and texts
   become places in that list. No vocabulary is ever sent to the texts as a whole. Words are dealt to
   buckets by hash; between blocks and buckets they travel as packed rows, one a block and bucket.
2. The most frequent words (`seeds`) are exchanged on the driver, from the bigrams among them.
3. Sweeps follow until the bigram likelihood of all training tokens stops growing, or `sweeps` of them.
   A sweep sends every word's class to the blocks that hold it, counts each word's neighbours by class,
   and gathers these counts by word. Then each word takes the class that makes its own neighbours
   likeliest: the seeds, which act on one another, one after the other on the driver with their exact
   gains under the counts of the whole corpus; all other words where they lie, from the class bigrams of
   the sweep, as one word's move hardly changes them. A sweep that lowers the likelihood is undone.

Only class matrices and the seeds' counts (bounds fixed by parameters) reach the driver.

A class keeps the share of its singletons for unknown words (all unknown words are one type, as in the
base), so probabilities sum to one over vocabulary and unknown. Unknown words leave the class context as
it was. A text begins in the class of the end token and closes with the end token.

Null or empty text: the end token alone. Very long texts: a text is never split, so a block may grow to
hold one. Ties: the class with the smaller number; among equally frequent words the smaller id is a seed.
Null and repeated doc_ids: see by_key (a null id is hashed as empty text). No training rows: every word is
unknown. Empty table: empty result. Other columns of the input are not touched. Words are told apart by
56-bit hashes: among n distinct words two share one with probability n^2 / 2^57.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lociq.llm.session import by_key, keep, release
from lociq.llm.text import U64, KeyCounter, lower, mix, pieces, span_hash, table, word_spans

END = 0
UNKNOWN = 255
BUCKET_BYTES = 4_000_000  # text for each bucket of words
MOST_CLASSES = 120  # two codes a class, and two for words without one, fit in a byte

#: What meets in a block: kind 0 the words of one bucket (words, n, cls), kind 1 a text (key, held_out, codes: places in the block's ascending word list).
BLOCK_ROW = "block long, kind int, bucket int, key long, held_out boolean, words binary, n binary, cls binary, codes binary"
#: What a block says of its words in one bucket; `per` codes and counts belong to each word.
COUNT_ROW = "bucket int, block long, words binary, n binary, cls binary, per binary, codes binary, counts binary"
#: A bucket: its words, and for each block their places among these words.
BUCKET_ROW = "bucket int, words binary, n binary, cls binary, per binary, codes binary, counts binary, blocks array<long>, places array<binary>"


def token_ids(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """56-bit word ids of all rows, each row closed by END, and the rows' offsets."""
    data = lower(data)
    starts, ends, row = word_spans(data, offs)
    rows = len(offs) - 1
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows) + 1)])
    ids = np.full(int(at[-1]), END, np.int64)
    ids[np.arange(len(row)) + row] = (span_hash(data, starts, ends - starts) >> U64(8)).astype(np.int64) | 1
    return ids, at


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose rows take `counts` of the values each, in order."""
    width = values.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(counts)]) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column without nulls, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw.tobytes(), kind), np.diff(offs) // width


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(words.view(U64)) % U64(buckets)).astype(np.int64)


def _row_batch(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    """A batch of the given columns; the others of the schema are null."""

    def column(field: pa.Field) -> pa.Array:
        given = columns.get(field.name)
        if given is None:
            return pa.nulls(size, field.type)
        return given if isinstance(given, pa.Array) else pa.array(given, field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def code_texts(docs: DataFrame, block_tokens: int, buckets: int) -> DataFrame:
    """Blocks of docs (key, held_out, text) as rows of BLOCK_ROW; n is a word's count in the block's training texts."""
    schema = _schema(BLOCK_ROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            ids, lens, out, keys = (np.concatenate([h[i] for h in held]) for i in range(4))
            block, held, size, number = np.int64(part) << 24 | number, [], 0, number + 1
            words, place = np.unique(ids, return_inverse=True)
            n = np.bincount(place[np.repeat(~out, lens)], minlength=len(words))
            which = bucket_of(words, buckets)
            order = np.argsort(which, kind="stable")
            found, per = np.unique(which, return_counts=True)
            yield _row_batch(schema, len(found), block=np.full(len(found), block), kind=np.zeros(len(found), np.int32), bucket=found.astype(np.int32), words=_binary(words[order], per), n=_binary(n[order], per))
            edge = np.concatenate([[0], np.cumsum(lens)])
            for lo in range(0, len(keys), 5000):
                hi = min(lo + 5000, len(keys))
                yield _row_batch(schema, hi - lo, block=np.full(hi - lo, block), kind=np.ones(hi - lo, np.int32), key=keys[lo:hi], held_out=out[lo:hi], codes=_binary(place[edge[lo] : edge[hi]].astype(np.uint32), lens[lo:hi]))

        for batch, data, offs in pieces(batches):
            ids, at = token_ids(data, offs)
            held.append((ids, np.diff(at), batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("key").to_numpy()))
            size += len(ids)
            if size >= block_tokens:
                yield from flush()
        if held:
            yield from flush()

    return docs.select("key", "held_out", "text").mapInArrow(work, BLOCK_ROW)


def gather(rows: DataFrame, add: bool = False) -> DataFrame:
    """Buckets (BUCKET_ROW) from what the blocks say (COUNT_ROW). A word's n is the same in all blocks, or with `add` their sum.

    codes and counts: how often the word follows (code = class) and precedes (code = classes + 1 + class) each class.
    """
    schema = _schema(BUCKET_ROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in key_runs(batches, "bucket"):
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            every, size = _values(col["words"], "<i8")
            words, first, place = np.unique(every, return_index=True, return_inverse=True)
            n = _values(col["n"], "<i8")[0]
            n = np.bincount(place, n, len(words)).astype(np.int64) if add else n[first]
            codes, counts = _values(col["codes"], "u1")[0], _values(col["counts"], "<u4")[0]
            key = np.repeat(place, _values(col["per"], "u1")[0]) * 256 + codes
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
            yield _row_batch(
                schema, 1, bucket=col["bucket"][:1], words=_packed(words), n=_packed(n), cls=_packed(_values(col["cls"], "u1")[0][first]), per=_packed(np.bincount(key[new] >> 8, minlength=len(words)).astype(np.uint8)),
                codes=_packed((key[new] & 255).astype(np.uint8)), counts=_packed(total), blocks=_listed(col["block"]), places=_listed(_binary(place.astype(np.uint32), size)))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, BUCKET_ROW)


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def key_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key, joined and cut so that each has one key."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(key)).to_numpy()
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != col[0]:
            yield joined()
            held = []
        cut = [0, *(np.flatnonzero(col[1:] != col[:-1]) + 1).tolist()]
        for lo, hi in zip(cut, [*cut[1:], None]):
            held.append(b.slice(lo, None if hi is None else hi - lo))
            if hi is not None:
                yield joined()
                held = []
    if held:
        yield joined()


@dataclass
class Bucket:
    """A row of BUCKET_ROW as arrays."""

    bucket: int
    words: np.ndarray
    n: np.ndarray
    cls: np.ndarray
    per: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    blocks: np.ndarray | None = None
    places: list[np.ndarray] | None = None

    def to_blocks(self, cls: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        """Each block's words of this bucket, with new classes, as rows of BLOCK_ROW."""
        size = np.array([len(p) for p in self.places], np.int64)
        at, k = np.concatenate(self.places).astype(np.int64), len(size)
        return _row_batch(schema, k, block=self.blocks, kind=np.zeros(k, np.int32), bucket=np.full(k, self.bucket, np.int32), words=_binary(self.words[at], size), n=_binary(self.n[at], size), cls=_binary(cls[at].astype(np.uint8), size))


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    kinds = {"words": "<i8", "n": "<i8", "cls": "u1", "per": "u1", "codes": "u1", "counts": "<i8"}
    for b in batches:
        for row in b.to_pylist():
            out = Bucket(row["bucket"], *(np.frombuffer(row[c], kind) for c, kind in kinds.items()))
            if "blocks" in row:
                out.blocks, out.places = np.array(row["blocks"], np.int64), [np.frombuffer(x, "<u4") for x in row["places"]]
            yield out


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Of each block, sorted by (block, kind): its number, its words in the order of its list (words, n, cls), and its texts in
    parts of (key, held_out, codes, codes a text), read as they come."""
    queue = (r for b in batches if b.num_rows for r in _same(b))
    ahead = next(queue, None)
    while ahead is not None:
        block, listed = ahead[0], {"words": [], "n": [], "cls": []}
        while ahead is not None and ahead[0] == block and ahead[1] == 0:
            for c, kind in (("words", "<i8"), ("n", "<i8"), ("cls", "u1")):
                listed[c].append(_values(ahead[2].column(c), kind)[0])
            ahead = next(queue, None)
        words = {c: np.concatenate(v or [np.zeros(0, np.int64)]) for c, v in listed.items()}
        order = np.argsort(words["words"])
        words = {c: v[order] for c, v in words.items()}

        def texts(block: int = block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == block:
                b = ahead[2]
                yield b.column("key").to_numpy(), b.column("held_out").to_numpy(zero_copy_only=False).astype(bool), *_values(b.column("codes"), "<u4")
                ahead = next(queue, None)

        rest = texts()
        yield block, words, rest
        for _ in rest:
            pass


def _same(b: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Slices of a batch with one block and kind."""
    block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
    cut = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
        yield int(block[lo]), int(kind[lo]), b.slice(lo, hi - lo)


def by_block(words: DataFrame, texts: DataFrame) -> DataFrame:
    """Words and texts (BLOCK_ROW) of each block together, words first."""
    return words.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")


def count_neighbours(blocks: DataFrame, classes: int, buckets: int) -> DataFrame:
    """COUNT_ROW of each block and bucket: neighbours of words in training texts, by the classes that came with the words.

    Class `classes` stands for words that have none yet; n is the word's count in all blocks.
    """
    schema = _schema(COUNT_ROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, texts in block_runs(batches):
            cls, size = words["cls"].astype(np.int64), len(words["words"])
            held = KeyCounter()
            for _, held_out, codes, each in texts:
                place = codes[np.repeat(~held_out, each)].astype(np.int64)
                if not len(place):
                    continue
                own = cls[place]
                left = np.concatenate([[0], own[:-1]])  # parts begin at a text's first word, after an end
                right = np.concatenate([own[1:], [0]])
                held.add(np.concatenate([place << 8 | left, place << 8 | (right + classes + 1)]))
                if held.full():
                    held.merge()
            key, count = held.merge()
            per = np.bincount(key >> 8, minlength=size)
            which = bucket_of(words["words"], buckets)
            order = np.argsort(which, kind="stable")
            found, in_bucket = np.unique(which, return_counts=True)
            sent = per[order]
            at = np.repeat((np.cumsum(per) - per)[order] - (np.cumsum(sent) - sent), sent) + np.arange(len(key))
            codes_in = np.add.reduceat(sent, np.cumsum(in_bucket) - in_bucket) if size else np.zeros(0, np.int64)
            yield _row_batch(
                schema, len(found), bucket=found.astype(np.int32), block=np.full(len(found), block, np.int64), words=_binary(words["words"][order], in_bucket), n=_binary(words["n"][order], in_bucket), cls=_binary(words["cls"][order].astype(np.uint8), in_bucket),
                per=_binary(sent.astype(np.uint8), in_bucket), codes=_binary((key[at] & 255).astype(np.uint8), codes_in), counts=_binary(count[at].astype(np.uint32), codes_in))

    return blocks.mapInArrow(work, COUNT_ROW)


def seed_bigrams(train: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """Bigram counts among the seeds (ascending word ids), as a square matrix."""
    size = len(seeds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size * size, np.int64)
        for _, data, offs in pieces(batches):
            ids, at = token_ids(data, offs)
            place = np.minimum(np.searchsorted(seeds, ids), size - 1)
            known = seeds[place] == ids
            before = np.concatenate([[END], ids[:-1]])  # END stands before each text's first word anyway
            seat = np.concatenate([[int(np.searchsorted(seeds, END))], place[:-1]])
            ok = known & np.concatenate([[bool((seeds == END).any())], known[:-1]]) & (before >= 0)
            counts += np.bincount(seat[ok] * size + place[ok], minlength=size * size)
        hit = np.flatnonzero(counts)
        yield table(pair=hit, n=counts[hit])

    rows = train.select("text").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size^2 rows
    out = np.zeros(size * size, np.int64)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def exchange(bigrams: np.ndarray, fixed: int, classes: int, sweeps: int = 12, of: np.ndarray | None = None, others: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Classes 1.. of the words whose bigram counts are given, most frequent first; word `fixed` alone is class 0.

    of: the classes to begin with. others: class bigrams of the whole corpus, and how often each word precedes and follows
    each class in pairs with words that are not given here.
    """

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    size = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    if of is None:
        of = np.empty(size, np.int64)
        of[order] = 1 + np.arange(size) % (classes - 1)
        of[fixed] = 0
    of = of.copy()
    if others is None:
        one = np.eye(classes)[of]
        n, far_right, far_left = one.T @ bigrams @ one, np.zeros((size, classes)), np.zeros((size, classes))
    else:
        n, far_right, far_left = (x.astype(float) for x in others)
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            if w == fixed:
                continue
            own, same = of[w], float(bigrams[w, w])
            right = np.bincount(of, bigrams[w], classes) + far_right[w]
            left = np.bincount(of, bigrams[:, w], classes) + far_left[w]
            right[own] -= same
            left[own] -= same
            n[own] -= right
            n[:, own] -= left
            n[own, own] -= same
            rows, cols, diag = n.sum(1), n.sum(0), np.diag(n)
            by_row = f(n + right) - f(n)
            by_col = f(n + left[:, None]) - f(n)
            gain = by_row.sum(1) - np.diag(by_row) + by_col.sum(0) - np.diag(by_col) + f(diag + right + left + same) - f(diag)
            gain -= f(rows + right.sum() + same) - f(rows) + f(cols + left.sum() + same) - f(cols)
            gain[0] = -np.inf
            best = int(gain.argmax()) if gain.max() > gain[own] + 1e-9 else int(own)
            moved += best != own
            of[w] = best
            n[best] += right
            n[:, best] += left
            n[best, best] += same
        if moved <= size // 500:
            break
    return of


def class_bigrams(gathered: DataFrame, classes: int) -> np.ndarray:
    """Class bigrams of all training tokens, from gathered counts; class `classes` is that of words without one."""
    wide = classes + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * wide, np.int64)
        for b in bucket_rows(batches):
            own = np.repeat(b.cls, b.per)
            left = (b.codes < wide) & (own < wide)
            total += np.bincount(b.codes[left].astype(np.int64) * wide + own[left], b.counts[left], wide * wide).astype(np.int64)
        hit = np.flatnonzero(total)
        yield table(pair=hit, n=total[hit])

    rows = gathered.drop("blocks", "places").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most (classes + 1)^2 rows
    out = np.zeros(wide * wide, np.int64)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(wide, wide)


def word_rows(gathered: DataFrame, seeds: np.ndarray | None = None, top: int | None = None) -> DataFrame:
    """(word, n, cls, codes, counts), a row a word: all words, or only the given ones (ascending), or the `top` most frequent of each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bucket_rows(batches):
            use = np.arange(len(b.words))
            if seeds is not None:
                use = use[np.isin(b.words, seeds)]
            if top is not None:
                use = use[np.argsort(-b.n[use], kind="stable")[:top]]
            edge = np.concatenate([[0], np.cumsum(b.per, dtype=np.int64)])
            codes, counts = (pa.array([x[edge[i] : edge[i + 1]].tobytes() for i in use.tolist()], pa.binary()) for x in (b.codes, b.counts))
            yield table(word=b.words[use], n=b.n[use], cls=b.cls[use].astype(np.int32), codes=codes, counts=counts)

    return gathered.drop("blocks", "places").mapInArrow(work, "word long, n long, cls int, codes binary, counts binary")


def sums_by_class(gathered: DataFrame) -> list:
    """Rows (cls, n, single, words): tokens, words that occur once, and words with training tokens, of each class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bucket_rows(batches):
            n, single, words = (np.bincount(b.cls, w, 256).astype(np.int64) for w in (b.n, b.n == 1, b.n > 0))
            yield table(cls=np.arange(256, dtype=np.int32), n=n, single=single, words=words)

    return gathered.drop("blocks", "places").mapInArrow(work, "cls int, n long, single long, words long").groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("n", "single", "words")]).collect()  # 256 rows


def place_seeds(gathered: DataFrame, seeds: np.ndarray, of: np.ndarray, classes: int) -> DataFrame:
    """BLOCK_ROW of all words: seeds (ascending ids) in their classes, other training words in class `classes`, the rest in UNKNOWN."""
    schema = _schema(BLOCK_ROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bucket_rows(batches):
            yield b.to_blocks(_seeded(b.words, np.where(b.n > 0, classes, UNKNOWN), seeds, of), schema)

    return gathered.mapInArrow(work, BLOCK_ROW)


def _seeded(words: np.ndarray, cls: np.ndarray, seeds: np.ndarray, of: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(seeds, words), len(seeds) - 1)
    return np.where(seeds[place] == words, of[place], cls)


def likelihood(pairs: np.ndarray) -> float:
    """The part of the bigram log-likelihood that depends on the classes."""

    def f(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1))).sum())

    return f(pairs) - f(pairs.sum(1)) - f(pairs.sum(0))


def likeliest(pairs: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each neighbour code for each class, and the cost a token of each class."""
    pair = pairs[:classes, :classes].astype(float)
    prior = (pair.sum(0) + 0.5) / (pair.sum() + 0.5 * classes)
    follow = np.log((pair + prior) / (pair.sum(1, keepdims=True) + 1))  # [class, next class]
    weight = np.zeros((2 * classes + 2, classes))
    weight[:classes] = follow
    weight[classes] = np.log(prior)
    weight[classes + 1 : 2 * classes + 1] = follow.T
    return weight, np.log(pair.sum(0) + 1)


def move_words(gathered: DataFrame, pairs: np.ndarray, classes: int, seeds: np.ndarray, of: np.ndarray) -> DataFrame:
    """BLOCK_ROW of all words: each in its likeliest class; seeds (ascending ids) in theirs, words without training tokens in UNKNOWN."""
    weight, total = likeliest(pairs, classes)
    schema = _schema(BLOCK_ROW)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bucket_rows(batches):
            edge = np.concatenate([[0], np.cumsum(b.per, dtype=np.int64)])
            best = np.empty(len(b.words), np.int64)
            for lo in range(0, len(b.words), 20_000):
                hi = min(lo + 20_000, len(b.words))
                s, n, cls = slice(edge[lo], edge[hi]), b.n[lo:hi], b.cls[lo:hi].astype(np.int64)
                seen = np.bincount(np.repeat(np.arange(hi - lo), b.per[lo:hi]) * len(weight) + b.codes[s], b.counts[s], (hi - lo) * len(weight)).reshape(hi - lo, -1)
                score = seen @ weight - n[:, None] * total
                score[:, 0] = -np.inf
                move, row = score.argmax(1), np.arange(hi - lo)
                stays = (cls < classes) & (score[row, np.minimum(cls, classes - 1)] >= score[row, move] - 1e-9)
                best[lo:hi] = np.where(n > 0, np.where(stays, cls, move), UNKNOWN)
            yield b.to_blocks(_seeded(b.words, best, seeds, of), schema)

    return gathered.mapInArrow(work, BLOCK_ROW)


def as_they_are(gathered: DataFrame) -> DataFrame:
    """BLOCK_ROW of all words in their classes."""
    schema = _schema(BLOCK_ROW)
    return gathered.mapInArrow(lambda batches: (b.to_blocks(b.cls, schema) for b in bucket_rows(batches)), BLOCK_ROW)


@dataclass
class Model:
    """What the sweeps found: kept tables of texts and words, class bigrams, and the likelihood a token after each sweep."""

    texts: DataFrame
    words: DataFrame
    pairs: np.ndarray
    tokens: int
    distinct: int
    likelihoods: list[float]


def learn(marked: DataFrame, classes: int, seeds: int, sweeps: int, least_gain: float, block_tokens: int) -> Model:
    """Exchange clustering over the training rows of marked (key, held_out, text); texts and words of all rows are coded."""
    buckets = 1 + (marked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES
    coded = keep(code_texts(marked, block_tokens, buckets), "coded")
    texts, none = coded.filter("kind = 1"), F.lit(b"")
    listed = coded.filter("kind = 0").select("bucket", "block", "words", "n", F.expr("cast(repeat('\\0', octet_length(words) div 8) AS binary)").alias("cls"), F.expr("cast(repeat('\\0', octet_length(words) div 8) AS binary)").alias("per"), none.alias("codes"), none.alias("counts"))
    words = keep(gather(listed, add=True), "vocabulary")
    totals = {"n": 0, "v": 0}
    for r in sums_by_class(words):
        totals = {"n": totals["n"] + r["n"], "v": totals["v"] + r["words"]}
    top = word_rows(words, top=seeds).filter("n > 0").orderBy(F.desc("n"), "word").select("word").limit(seeds).collect()
    start = np.unique(np.array([END, *[r["word"] for r in top]], np.int64))
    bigrams = seed_bigrams(marked.filter("NOT held_out"), start)
    of = exchange(bigrams, int(np.searchsorted(start, END)), classes)
    placed = place_seeds(words, start, of, classes)
    found, best, grown = None, None, []
    for sweep in range(sweeps + 1):
        counted = keep(gather(count_neighbours(by_block(placed, texts), classes, buckets)), f"sweep{sweep}")
        if not sweep:
            release(words)
        pairs = class_bigrams(counted, classes)
        if sweep:  # the classes counted by sweep 0 are those of the seeds alone
            grown.append(likelihood(pairs[:classes, :classes]) / max(totals["n"], 1))
        if sweep > 1 and grown[-1] <= grown[-2]:
            release(counted)
            break
        if found is not None:
            release(found)
        found, best = counted, pairs
        if sweep == sweeps or not totals["v"] or sweep > 1 and grown[-1] - grown[-2] < least_gain:
            break
        if sweep:
            of = exchange(bigrams, int(np.searchsorted(start, END)), classes, 4, of, _around_seeds(counted, start, of, bigrams, pairs, classes))
        placed = move_words(counted, pairs, classes, start, of)
    return Model(texts, found, best[:classes, :classes].astype(float), int(totals["n"]), int(totals["v"]), grown)


def _around_seeds(counted: DataFrame, seeds: np.ndarray, of: np.ndarray, bigrams: np.ndarray, pairs: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class bigrams, and the seeds' neighbours by class without those that are seeds."""
    right, left = np.zeros((len(seeds), classes)), np.zeros((len(seeds), classes))
    wanted = word_rows(counted, seeds).select("word", "codes", "counts").toArrow()  # a row a seed
    for word, codes, counts in zip(*(wanted.column(i).to_pylist() for i in range(3))):
        i = int(np.searchsorted(seeds, word))
        codes, counts = np.frombuffer(codes, np.uint8), np.frombuffer(counts, "<i8")
        before, after = codes < classes, (codes > classes) & (codes < 2 * classes + 1)
        left[i, codes[before]] += counts[before]
        right[i, codes[after].astype(np.int64) - classes - 1] += counts[after]
    one = np.eye(classes)[of]
    return pairs[:classes, :classes], np.maximum(right - bigrams @ one, 0), np.maximum(left - (one.T @ bigrams).T, 0)


def score_texts(model: Model, blocks: DataFrame, share: np.ndarray, follow: np.ndarray, unknown: np.ndarray) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of the blocks' texts.

    share: log10 of the known share of each class over its tokens.
    """
    tokens, distinct = model.tokens, model.distinct
    base = np.log10(tokens + 0.1 * (distinct + 1))
    step, lost = np.log10(follow), np.log10(unknown)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, texts in block_runs(batches):
            cls, n = words["cls"].astype(np.int64), words["n"]
            word_base = np.log10(n + 0.1) - base
            word_emission = np.where(n > 0, np.log10(np.maximum(n, 1)) + share[np.minimum(cls, len(share) - 1)], 0.0)
            for key, held_out, codes, each in texts:
                code = cls[codes]
                row, context, known = _contexts(code, each)
                rows = len(each)
                score = np.where(known, step[context, np.where(known, code, 0)], lost[context]) + word_emission[codes]
                score = np.bincount(row, score, rows)
                yield table(key=key, held_out=held_out, n_tokens=each, n_known=np.bincount(row, known, rows).astype(np.int64), train_tokens=np.full(rows, tokens), base_score=np.bincount(row, word_base[codes], rows), score=score, perplexity=10 ** (-score / each))

    return blocks.mapInArrow(work, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def _contexts(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and class context (the last known one) of every token, and whether it is known."""
    row = np.repeat(np.arange(len(size)), size)
    known = codes != UNKNOWN
    latest = np.maximum.accumulate(np.where(known, np.arange(len(codes)), -1))
    before = np.concatenate([[-1], latest[:-1]])
    context = np.where(before >= 0, codes[before], 0)
    start = np.repeat(np.cumsum(size) - size, size)
    context[before < start] = 0  # nothing known yet in this text: the end class stands before it
    return row, context, known


def class_scores(docs: DataFrame, folds: int = 10, classes: int = 48, seeds: int = 1024, sweeps: int = 4, least_gain: float = 2e-3, block_tokens: int = 3_000_000) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from rows whose crc32(doc_id as text) mod folds is not 0. seeds: words that the first exchange
    places and that later exchanges take one by one. sweeps: most sweeps over all words; fewer are made once one gains less
    than least_gain nats a token. block_tokens: tokens of a block.
    """
    if not 2 <= classes <= MOST_CLASSES:
        raise ValueError(f"classes must be 2 to {MOST_CLASSES}")

    def work(keyed: DataFrame) -> DataFrame:
        marked = keyed.select("key", "text", (F.crc32(F.col("id_text").cast("binary")) % folds == 0).alias("held_out"))
        model = learn(marked, classes, seeds, sweeps, least_gain, block_tokens)
        size, single = np.zeros(classes), np.zeros(classes)
        for r in sums_by_class(model.words):
            if r["cls"] < classes:
                size[r["cls"]], single[r["cls"]] = r["n"], r["single"]
        unseen = (single + 0.5) / (size + 1.0)
        unseen[0] = 1e-12  # the end token is never unknown
        unseen = np.minimum(unseen, 0.9)
        share = np.log10(1 - unseen) - np.log10(np.maximum(size, 1))
        pair = model.pairs
        prior = (pair.sum(0) + 0.1) / (pair.sum() + 0.1 * classes)
        follow = (pair + 2 * prior) / (pair.sum(1, keepdims=True) + 2)
        return score_texts(model, by_block(as_they_are(model.words), model.texts), share, follow, follow @ unseen)

    return by_key(docs, work)
