"""Token-id files in directly addressable codes.

Ids are split into eight-bit chunks, lowest first. Each level holds the chunks of the ids that reach it,
a continuation bitmap that says which of them go on, and a rank directory (set bits before every 512th),
so the k-th id is read from one chunk a level without decoding its neighbours.

A file is a Parquet table whose rows are shards of whole documents, in ascending order of key: part
(range partition), before (ids of the partition ahead of the shard), keys, ends (of each document's ids
in the shard), and the levels' chunks, bitmaps and ranks.

Null or empty text: the end id alone. Very long texts: a document is never split, so a shard may grow to hold
one. Null and repeated doc_ids: nulls first, then by text, each row a
document of its own. Empty table: no shards. Other columns of the input are not touched.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.session import by_key, scratch_dir
from lociq.llm.text import pieces, table
from lociq.llm.tokens import WordEncoder, default_path

RANK_BITS = 512
SHARD = "part int, before long, n long, keys array<long>, ends array<long>, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"


def encode_ids(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of the levels; the last level needs no bitmap."""
    chunks, bitmaps, ranks = [], [], []
    while True:
        chunks.append((ids & 255).astype(np.uint8).tobytes())
        rest = ids >> 8
        more = rest > 0
        if not more.any():
            return chunks, bitmaps, ranks
        bits = np.packbits(more, bitorder="little")
        bitmaps.append(bits.tobytes())
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4").tobytes())
        ids = rest[more]


def decode_ids(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    ids = np.frombuffer(chunks[-1], np.uint8).astype(np.uint32)
    for level in range(len(bitmaps) - 1, -1, -1):
        low = np.frombuffer(chunks[level], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(bitmaps[level], np.uint8), count=len(low), bitorder="little").astype(bool)
        low[more] |= ids << np.uint32(8)
        ids = low
    return ids


def id_at(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], k: int) -> int:
    """The k-th id of a shard, from one chunk a level."""
    out = 0
    for level, chunk in enumerate(chunks):
        out |= chunk[k] << (8 * level)
        if level == len(bitmaps) or not bitmaps[level][k >> 3] >> (k & 7) & 1:
            return out
        block = k // RANK_BITS
        ahead = np.frombuffer(bitmaps[level], np.uint8, (k >> 3) - block * RANK_BITS // 8, block * RANK_BITS // 8)
        part = bitmaps[level][k >> 3] & ((1 << (k & 7)) - 1)
        k = int(np.frombuffer(ranks[level], "<u4", 1, 4 * block)[0]) + int(np.bitwise_count(ahead).sum()) + part.bit_count()
    return out


def write_codes(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2, shard_ids: int = 1 << 20) -> None:
    """Tokenise docs (key, text) in ascending order of key and write their shards to path."""
    tokenizer = tokenizer or default_path()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, before, held = TaskContext.get().partitionId(), WordEncoder.of(tokenizer), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal before, held
            ids = np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            chunks, bitmaps, ranks = encode_ids(ids)
            row = {"part": part, "before": before, "n": len(ids), "keys": np.concatenate([h[0] for h in held]), "ends": np.cumsum(sizes), "chunks": chunks, "bitmaps": bitmaps, "ranks": ranks}
            before, held = before + len(ids), []
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.list_(pa.binary())] * 3
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

        for batch, data, offs in pieces(batches):
            ids, at = encoder.encode(data, offs, end)
            held.append((batch.column("key").to_numpy(), ids, np.diff(at)))
            if sum(len(h[1]) for h in held) >= shard_ids:
                yield flush()
        if held:
            yield flush()

    docs.select("key", "text").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(shards, SHARD).write.parquet(path)


def read_codes(spark, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files at path."""
    files = spark.read.schema(SHARD).parquet(path)
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a range partition
    base, total = {}, 0
    for part in sorted(totals):
        base[part], total = total, total + totals[part]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("part", "before", "chunks", "bitmaps")}
                keys, ends = (batch.column(name)[i].values.to_numpy() for name in ("keys", "ends"))
                raw = memoryview(decode_ids(row["chunks"], row["bitmaps"]).astype("<u4").tobytes())
                starts = np.concatenate([[0], ends[:-1]])
                crc = np.fromiter((zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, len(ends))
                yield table(key=keys, start=base[row["part"]] + row["before"] + starts, n_tokens=ends - starts, ids_crc32=crc)

    return files.select("part", "before", "keys", "ends", "chunks", "bitmaps").mapInArrow(documents, "key long, start long, n_tokens long, ids_crc32 long")


def token_at(spark, path: str, wanted: DataFrame) -> DataFrame:
    """(key, k, id) for wanted (key, k): the k-th id (from 0) of document key, read by direct access; null beyond its end or for no document.

    A wanted pair meets the shard of its document by key, and a shard answers all that are asked of it at once.
    """
    files = spark.read.schema(SHARD).parquet(path)
    asked = wanted.select(F.col("key").cast("long").alias("key"), F.col("k").cast("long").alias("k")).distinct()
    homes = files.select("part", "before", F.posexplode("keys").alias("i", "key"), "ends")
    homes = homes.select("key", "part", "before", F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0).alias("lo"), F.get("ends", F.col("i")).alias("hi"))
    placed = asked.join(homes, "key").filter(F.col("k").between(0, F.col("hi") - F.col("lo") - 1)).groupBy("part", "before").agg(F.collect_list(F.struct("key", "k", (F.col("lo") + F.col("k")).alias("at"))).alias("asked"))  # at most a shard's ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("chunks", "bitmaps", "ranks", "asked")}
                ids = [id_at(row["chunks"], row["bitmaps"], row["ranks"], x["at"]) for x in row["asked"]]
                yield table(key=np.array([x["key"] for x in row["asked"]], np.int64), k=np.array([x["k"] for x in row["asked"]], np.int64), id=np.array(ids, np.int64))

    found = files.select("part", "before", "chunks", "bitmaps", "ranks").join(placed, ["part", "before"]).select("chunks", "bitmaps", "ranks", "asked").mapInArrow(read, "key long, k long, id long")
    return asked.join(found, ["key", "k"], "left")


def token_files(docs: DataFrame, tokenizer: str | None = None, end: int = 2, path: str | None = None) -> DataFrame:
    """Write docs to files (in the shared scratch folder unless path is given) and describe them from what is read back."""
    spark = docs.sparkSession

    def work(keyed: DataFrame) -> DataFrame:
        to = path or f"{scratch_dir(spark)}/codes-{uuid.uuid4().hex}"
        write_codes(keyed, to, tokenizer, end)
        return read_codes(spark, to)

    return by_key(docs, work)
