"""Sinks: result tables, combined matrices, browser tracks, count tracks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.operators.joins import assign_sites
from lociq.operators.normalise import normalize


def write_result(df: DataFrame, kind: str, info: dict, path: str) -> None:
    """A result file in parts: path/head with #kind, a #yaml: block of the run's settings and a # line of column names, and
    path/rows with tab-separated rows. Put together in this order the parts are one result file; read_result takes the folder.

    Nulls are empty cells; cells of array, map and struct columns are JSON; tabs and line breaks in cells become spaces.
    """
    spark = df.sparkSession
    head = [f"#{kind}", "#yaml:", *[f"#  {k}: {v if isinstance(v, (str, int, float)) else json.dumps(v)}" for k, v in info.items()], "#" + "\t".join(df.columns)]
    spark.range(1).select(F.lit("\n".join(head)).alias("value")).write.text(f"{path}/head")
    cells = [F.to_json(F.col(f"`{c}`")) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`").cast("string") for c, t in df.dtypes]
    df.select(F.array_join(F.array(*[F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ") for c in cells]), "\t").alias("value")).write.text(f"{path}/rows")


def _wide(site_counts: DataFrame, ids: list[str], decimals: str) -> DataFrame:
    cell: Column = F.format_string(decimals, F.first("count").cast("long") if decimals == "%d" else F.first("count"))
    return site_counts.groupBy("contig", "position").pivot("sample_id", ids).agg(cell)


def combined_table(site_counts: DataFrame, genes: DataFrame, ids: list[str], method: str = "TTR") -> DataFrame:
    """position, a column a sample, and the genes over each site as "orf,name" pairs; raw counts as integers, others with one decimal."""
    wide = _wide(normalize(site_counts, method), ids, "%d" if method == "nonorm" else "%.1f")
    over = assign_sites(site_counts.select("contig", "position").distinct(), genes, ignore_codon=False)
    named = over.groupBy("contig", "position").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "orf", "name"))), "\t").alias("genes"))
    return wide.join(named, ["contig", "position"], "left")


def export_combined_wig(site_counts: DataFrame, genes: DataFrame, ids: list[str], path: str, method: str = "TTR") -> None:
    """The matrix as tab-separated text under path/matrix, sorted by position, and a metadata template under path/metadata."""
    spark = site_counts.sparkSession
    table = combined_table(site_counts, genes, ids, method).sort("contig", "position")
    table.select(F.concat_ws("\t", F.col("position").cast("string"), *[F.col(f"`{i}`") for i in ids], F.coalesce("genes", F.lit(""))).alias("value")).write.text(f"{path}/matrix")
    header = spark.createDataFrame([(f"#File: {i}",) for i in ids], "value string").coalesce(1)
    header.write.text(f"{path}/header")
    spark.createDataFrame([(i, "", i) for i in ids], "Id string, Condition string, Filename string").write.option("sep", "\t").option("header", True).csv(f"{path}/metadata")


def igv_table(site_counts: DataFrame, ids: list[str], chromosome: str, method: str = "TTR") -> DataFrame:
    wide = _wide(normalize(site_counts, method), ids, "%.1f")
    return wide.select(F.lit(chromosome).alias("Chromosome"), F.col("position").alias("Start"), (F.col("position") + 1).alias("End"), F.concat(F.lit("TA"), F.col("position").cast("string")).alias("Feature"), *[F.col(f"`{i}`") for i in ids], F.lit(1).alias("TAs"))


def export_igv(site_counts: DataFrame, ids: list[str], chromosome: str, path: str, method: str = "TTR") -> None:
    igv_table(site_counts, ids, chromosome, method).sort("Start").write.option("sep", "\t").option("header", True).csv(path)


def export_normalized(site_counts: DataFrame, path: str, method: str = "TTR", whole: bool = False) -> None:
    """Normalised counts, a folder a sample; whole truncates to integers, as single tracks are written."""
    out = normalize(site_counts, method)
    cell = F.col("count").cast("long").cast("string") if whole else F.format_string("%.1f", "count")
    out.select("sample_id", F.concat_ws(" ", F.col("position").cast("string"), cell).alias("value")).write.partitionBy("sample_id").text(path)


def export_counts_wig(counts: DataFrame, path: str) -> None:
    """Template counts per replicon: path/wig as "position count" lines and path/counts as the seven-column table."""
    counts.select("contig", F.concat_ws(" ", F.col("position").cast("string"), F.col("tot_templ_ct").cast("string")).alias("value")).write.partitionBy("contig").text(f"{path}/wig")
    counts.write.partitionBy("contig").option("sep", "\t").option("header", True).csv(f"{path}/counts")


def gff_to_prot_table(gff: DataFrame) -> DataFrame:
    """Coding rows with a locus_tag as gene intervals; size int(abs(end - start + 1) / 3)."""
    cds = gff.filter((F.col("type") == "CDS") & F.col("attributes").getItem("locus_tag").isNotNull())
    name = F.coalesce(F.col("attributes").getItem("gene"), F.lit("-"))
    return cds.select(F.coalesce(F.col("attributes").getItem("product"), F.lit("-")).alias("description"), "start", "end", "strand", F.floor(F.abs(F.col("end") - F.col("start") + 1) / 3).cast("long").alias("aa_len"), F.lit("-").alias("_a"), F.lit("-").alias("_b"), name.alias("name"), F.col("attributes").getItem("locus_tag").alias("orf"), F.lit("-").alias("cog"))
