"""Read counting over streams: the batch operators are plain DataFrame functions, so they take a stream as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators.reads import GUIDE_AFTER, GUIDE_BEFORE, extract_between


def stream_reads(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """(seq) of text files of sequences, one a line, as they appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.col("value").alias("seq"))


def stream_barcode_counts(reads: DataFrame) -> DataFrame:
    """Running (barcode, count) of the text between the guide constants, for outputMode update or complete."""
    return extract_between(reads, GUIDE_BEFORE, GUIDE_AFTER, 10, 30, missing=None).filter("barcode IS NOT NULL").groupBy("barcode").agg(F.count("*").alias("count"))


def stream_site_counts(alignments: DataFrame) -> DataFrame:
    """Running (contig, position, strand, count) of single-end alignments."""
    placed = alignments.filter(F.col("flag").isin(0, 16)).withColumn("strand", F.when(F.col("flag") == 0, "F").otherwise("R"))
    placed = placed.withColumn("position", F.when(F.col("strand") == "F", F.col("pos") - 2).otherwise(F.col("pos") + F.col("seq_len")))
    return placed.groupBy("contig", "position", "strand").agg(F.count("*").alias("count"))
