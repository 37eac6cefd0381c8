"""Scratch tables and document keys shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir, or on a local master, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("lociq.scratch.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-lociq-")
        spark.conf.set("lociq.scratch.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")  # the table stands for the shuffles behind it, so their files can go at once
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete kept tables that no later plan reads."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def by_key(docs: DataFrame, work: Callable[[DataFrame], DataFrame], refers: tuple[str, ...] = (), carry: bool = False) -> DataFrame:
    """Run work on (key, text, id_text), key a unique non-null long, and return its result with doc_id for key.

    doc_id itself is the key where it is unique and not null. Otherwise rows are ordered by
    (doc_id, text), nulls first, and numbered, so that repeated ids are documents of their own.
    Columns named in `refers` hold keys of other documents and are mapped back too. With `carry`, work also
    gets the other columns of docs, as the struct _rest, and whether the text is null, as _void.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_text"),
                      *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest"), F.col("text").isNull().alias("_void")] if carry else []))
    counted = ids.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("gap")).first()
    if (counted["most"] or 0) <= 1 and not counted["gap"]:
        return work(ids.withColumnRenamed("doc_id", "key")).withColumnRenamed("key", "doc_id")
    numbered = keep(ids.sort("doc_id", "text").withColumn("key", F.monotonically_increasing_id()), "keyed")
    out = work(numbered.drop("doc_id"))
    for column in ("key", *refers):
        names = numbered.select(F.col("key").alias(column), F.col("doc_id").alias("_named"))
        out = out.join(names, column, "left").drop(column).withColumnRenamed("_named", "doc_id" if column == "key" else column)
    return out
