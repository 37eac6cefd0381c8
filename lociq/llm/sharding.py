"""Shards by proportional stratified interleaving (native: DataFrame functions only).

Within each source the rows are shuffled by a seeded digest of their ids and ranked; rank r of n rows becomes
the fraction (2 r + 1) / 2 n. All rows are sorted by fraction, then source, and the sequence is cut into runs of
equal row counts, so that every shard holds each source in proportion to the whole, to within a few rows.

The law is `rows`: counts of shards are at most one apart. Equal texts are rows like all others and are spread
over shards with the rest: shards of equal counts cannot hold a third of all rows as one group.

Null source: a stratum of its own. Null text: size 1, checksum 0. Null ids: shuffled as one id. Ties (repeated ids):
by checksum and size; rows equal in all of these are alike and may take each other's places. Very long texts: only
size and checksum of a text are moved. Empty table: empty result. Other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.ordering import ranked
from lociq.llm.session import by_key, keep

SHARDS = 16
SEED = 12


def places(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(id, stratum, size, crc) with shard and slot."""
    mixed = rows.withColumn("mix", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary")))
    within = ranked(mixed, ["mix", "id", "crc", "size"], "stratum", "strata")
    spread = within.select("id", "stratum", "size", "crc", ((2 * F.col("rank") + 1).cast("double") / (2 * F.col("total")).cast("double")).alias("fraction"))
    placed = ranked(spread, ["fraction", "stratum", "id"], None, "interleaved")
    shard = F.expr(f"(rank * {shards}L) div total")
    start = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")  # the first rank of a shard
    return placed.withColumn("shard", shard).select("id", "stratum", "size", "crc", F.col("shard").cast("int").alias("shard"), (F.col("rank") - start).alias("slot"))


def _slim(docs: DataFrame, name: str, stratum: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(name).cast("long").alias("id"), F.col(stratum).alias("stratum"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))


def shard_slots(docs: DataFrame, shards: int = SHARDS, stratum: str = "source", seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: only the law `key` grows)."""
    found = places(_slim(docs, "doc_id", stratum), shards, seed)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, stratum: str = "source", seed: int = SEED, rows_a_file: int = 1_000_000) -> DataFrame:
    """Write all columns of docs under path/shard=K in the order of their slots, and return (shard, slot and docs' columns) as read back.

    A shard is written by as many tasks as it has runs of rows_a_file slots.
    """
    def work(keyed: DataFrame) -> DataFrame:
        slots = keep(places(keyed.select(F.col("key").alias("id"), F.col(f"_rest.`{stratum}`").alias("stratum"), (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc")), shards, seed), "slots")
        return keyed.join(slots.select(F.col("id").alias("key"), "shard", "slot"), "key")

    found = by_key(docs, work, carry=True)
    whole = found.select("shard", "slot", F.struct(*[F.when(F.col("_void"), None).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns]).alias("doc"))
    run = F.expr(f"slot div {rows_a_file}L")
    whole.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path).select(F.col("shard").cast("int").alias("shard"), "slot", "doc")
