"""Read-level operators: trimming, barcodes, counting at sites, library summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the sequencing protocols.
ADAPTER2 = "TACCACGACCA"
PREFIX_HIMAR1 = "ACTTATCAGCCAACCTGTTA"
GUIDE_BEFORE, GUIDE_AFTER = "GTACAAAAAC", "TCCCAGATTA"


def find_with_mismatches(text: Column, pattern: str, most: int = 0, legacy_range: bool = False) -> Column:
    """0-based first place where pattern stands in text with at most `most` substitutions, -1 if none; an exact hit comes first.

    legacy_range leaves the last offset untested.
    """
    exact = F.instr(text, pattern) - 1
    if most == 0:
        return exact.cast("int")
    @F.pandas_udf("int")
    def near(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("").tolist()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        end, parts, lo = np.cumsum(size), [], 0
        while lo < len(texts):  # runs of about RUN letters
            hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + RUN, "right")))
            data = np.frombuffer("".join(texts[lo:hi]).encode("ascii", "replace"), np.uint8)
            offs = np.concatenate([[0], np.cumsum(size[lo:hi])])
            hit = first_hits(data, offs, pattern, 0)
            missed = hit < 0
            hit[missed] = first_hits(data, offs, pattern, most, int(legacy_range))[missed]
            parts.append(hit)
            lo = hi
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64)).astype("int32")

    return near(text)


RUN = 1 << 22  # letters that are searched at once


def mismatches_above(data: np.ndarray, pattern: str, most: int) -> np.ndarray:
    """For each place of data, whether more than `most` letters of pattern differ there; 64 places a step.

    Each letter of the pattern has a mask of the places that hold it. Shifted by the letter's place in the pattern, the masks of
    misses are added up in bit planes: plane j says where more than j misses were seen.
    """
    words, n = len(data) // 64 + len(pattern) // 64 + 3, len(data)
    masks = {}
    for c in set(pattern.encode()):
        bits = np.packbits(data == c, bitorder="little")
        masks[c] = np.concatenate([bits, np.zeros(8 * words - len(bits), np.uint8)]).view("<u8")
    planes = np.zeros((most + 1, words), np.uint64)
    for i, c in enumerate(pattern.encode()):
        skip, shift = divmod(i, 64)
        held = np.zeros(words, np.uint64)
        held[: words - skip] = masks[c][skip:] >> np.uint64(shift)
        if shift:
            held[: words - skip - 1] |= masks[c][skip + 1 :] << np.uint64(64 - shift)
        for j in range(most, 0, -1):
            planes[j] |= planes[j - 1] & ~held
        planes[0] |= ~held
    return np.unpackbits(planes[most].view(np.uint8), bitorder="little")[:n].astype(bool)


def first_hits(data: np.ndarray, offs: np.ndarray, pattern: str, most: int, less: int = 0) -> np.ndarray:
    """The first place of pattern in each read data[offs[i]:offs[i + 1]] with `most` misses or fewer, -1 if none; the last `less` places do not count."""
    out = np.full(len(offs) - 1, -1, np.int64)
    at = np.flatnonzero(~mismatches_above(data, pattern, most))
    row = np.searchsorted(offs, at, "right") - 1
    inside = at + len(pattern) + less <= offs[row + 1]
    rows, first = np.unique(row[inside], return_index=True)
    out[rows] = at[inside][first] - offs[rows]
    return out


def trim_transposon_prefix(reads: DataFrame, prefix: str = PREFIX_HIMAR1, lo: int = 0, hi: int = 20, mismatches: int = 1, shortest: int = 20, adapter: str = ADAPTER2) -> DataFrame:
    """Reads with `insert` (the bases after the prefix, up to the adapter) and `kept`; failed reads stay, marked."""
    found = reads.withColumn("_at", find_with_mismatches(F.col("seq"), prefix, mismatches))
    rest = F.expr(f"substring(seq, _at + {len(prefix) + 1})")
    found = named(found, "_rest", F.when(F.col("_at").between(lo, hi), rest)).withColumn("_cut", find_with_mismatches(F.coalesce("_rest", F.lit("")), adapter, 1 if mismatches else 0))
    insert = F.when(F.col("_cut") >= 0, F.expr("substring(_rest, 1, _cut)")).otherwise(F.col("_rest"))
    return found.withColumn("insert", insert).withColumn("kept", F.coalesce(F.length("insert") >= shortest, F.lit(False))).drop("_at", "_rest", "_cut")


def extract_template_barcodes(reads: DataFrame, const1: str, const2: str, const3: str, mismatches: int = 1) -> DataFrame:
    """Layout const1 - barcode - const2 - genomic - const3: barcode of 5 to 15 bases, else X..., and the genomic part."""
    a = reads.withColumn("_a", find_with_mismatches(F.col("seq"), const1, mismatches))
    a = a.withColumn("_tail", F.when(F.col("_a") >= 0, F.expr(f"substring(seq, _a + {len(const1) + 1})")).otherwise(""))
    b = a.withColumn("_b", find_with_mismatches(F.col("_tail"), const2, mismatches))
    b = b.withColumn("_gen", F.when(F.col("_b") >= 0, F.expr(f"substring(_tail, _b + {len(const2) + 1})")).otherwise(""))
    c = b.withColumn("_c", find_with_mismatches(F.col("_gen"), const3, mismatches))
    barcode = F.when((F.col("_b") >= 5) & (F.col("_b") <= 15), F.expr("substring(_tail, 1, _b)")).otherwise("XXXXXXXXXX")
    genomic = F.when(F.col("_c") >= 0, F.expr("substring(_gen, 1, _c)")).otherwise(F.col("_gen"))
    return c.withColumn("barcode", barcode).withColumn("genomic", genomic).drop("_a", "_b", "_c", "_tail", "_gen")


def named(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: the generator keeps the optimiser from repeating its expression at each use."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def extract_between(reads: DataFrame, before: str, after: str, lo: int, hi: int, name: str = "barcode", missing: str | None = "XXXXXXXXXX") -> DataFrame:
    """The text between two constants if it has lo to hi bases, else `missing`. Built-in functions only."""
    a = F.instr("seq", before)
    tail = F.when(a > 0, F.expr(f"substring(seq, instr(seq, '{before}') + {len(before)})"))
    found = named(reads, "_tail", tail).withColumn("_b", F.instr("_tail", after) - 1)
    ok = F.col("_b").between(lo, hi)
    return found.withColumn(name, F.when(ok, F.expr("substring(_tail, 1, _b)")).otherwise(F.lit(missing))).drop("_tail", "_b")


def mate_id(column: str = "read_id") -> Column:
    """Read ids without the mate's number: up to the first space, and without /1 or /2."""
    return F.regexp_replace(F.split(F.col(column), " ")[0], "/[12]$", "")


def select_mates(reads2: DataFrame, kept1: DataFrame) -> DataFrame:
    return reads2.withColumn("_id", mate_id()).join(kept1.select(mate_id().alias("_id")).distinct(), "_id", "left_semi").drop("_id")


def attach_barcodes(reads1: DataFrame, barcodes2: DataFrame) -> DataFrame:
    return reads1.withColumn("_id", mate_id()).join(barcodes2.select(mate_id().alias("_id"), "barcode"), "_id").drop("_id")


def select_cycles(reads: DataFrame, i: int, j: int) -> DataFrame:
    """Bases i to j, counted from 1 and both included."""
    return reads.withColumn("seq", F.substring("seq", i, j - i + 1))


def reverse_complement(column: Column) -> Column:
    return F.reverse(F.translate(column, "ACGT", "TGCA"))


def read_counts(alignments: DataFrame, sites: DataFrame, protocol: str = "sassetti") -> DataFrame:
    """Reads per site and strand, for every site: (contig, position, fwd, rev, total).

    Single-end, flags 0 and 16; the site is 2 before a forward read and at the end of a reverse one. Mme1 has two candidate sites.
    """
    kept = alignments.filter(F.col("flag").isin(0, 16)).withColumn("strand", F.when(F.col("flag") == 0, "F").otherwise("R"))
    if protocol == "mme1":
        delta = F.when(F.col("strand") == "F", F.col("seq_len")).otherwise(1)
        placed = kept.withColumn("position", F.explode(F.array(F.col("pos") + delta - 2, F.col("pos") + delta - 1)))
    else:
        placed = kept.withColumn("position", F.when(F.col("strand") == "F", F.col("pos") - 2).otherwise(F.col("pos") + F.col("seq_len")))
    counts = placed.groupBy("contig", "position").agg(F.sum((F.col("strand") == "F").cast("long")).alias("fwd"), F.sum((F.col("strand") == "R").cast("long")).alias("rev"))
    return sites.select("contig", "position").join(counts, ["contig", "position"], "left").fillna(0, ["fwd", "rev"]).withColumn("total", F.col("fwd") + F.col("rev"))


def template_counts(alignments: DataFrame, sites: DataFrame) -> DataFrame:
    """Reads and distinct templates (strand, length, barcode) per site and strand, of properly paired first mates."""
    flag = F.col("flag")
    ok = (flag.bitwiseAND(64) != 0) & (flag.bitwiseAND(2) != 0) & ~F.col("cigar").contains("S") & (F.col("barcode") != "XXXXXXXXXX")
    placed = alignments.filter(ok).withColumn("strand", F.when(flag.bitwiseAND(16) != 0, "R").otherwise("F"))
    placed = placed.withColumn("position", F.when(F.col("strand") == "F", F.col("pos") - 2).otherwise(F.col("pos") + F.col("seq_len")))
    # Templates are counted from their distinct rows, which combine before the shuffle; a hot site spreads over its templates.
    each = placed.groupBy("contig", "position", "strand", "tlen", "barcode").agg(F.count("*").alias("_n"))
    pick = lambda s, c: F.coalesce(F.sum(F.when(F.col("strand") == s, c)), F.lit(0)).cast("long")
    counts = each.groupBy("contig", "position").agg(
        pick("F", F.col("_n")).alias("fwd_rd_ct"), pick("F", F.lit(1)).alias("fwd_templ_ct"), pick("R", F.col("_n")).alias("rev_rd_ct"), pick("R", F.lit(1)).alias("rev_templ_ct"))
    out = sites.select("contig", "position").join(counts, ["contig", "position"], "left").fillna(0)
    return out.withColumn("tot_rd_ct", F.col("fwd_rd_ct") + F.col("rev_rd_ct")).withColumn("tot_templ_ct", F.col("fwd_templ_ct") + F.col("rev_templ_ct"))


def ta_sites(genome: DataFrame, transposon: str = "himar1") -> DataFrame:
    """(contig, position) of TA dinucleotides, or of every base, from chunks (contig, chunk_start, seq) that overlap by a base."""
    chars = genome.select("contig", "chunk_start", "seq", F.explode(F.sequence(F.lit(1), F.greatest(F.length("seq") - 1, F.lit(1)))).alias("_i"))
    if transposon == "himar1":
        chars = chars.filter(F.expr("substring(seq, _i, 2) = 'TA'"))
    return chars.select("contig", (F.col("chunk_start") + F.col("_i") - 1).alias("position")).distinct()


def preprocess_stats(counts: DataFrame, reads: DataFrame) -> DataFrame:
    """One row of library figures from template counts and trimmed reads."""
    a = counts.agg(
        F.sum("tot_rd_ct").alias("read_count"), F.sum("tot_templ_ct").alias("template_count"), F.count("*").alias("sites"), F.count_if(F.col("tot_templ_ct") > 0).alias("sites_hit"),
        F.max("tot_templ_ct").alias("max_count"), F.min(F.when(F.col("tot_templ_ct") > 0, F.col("position"))).alias("first_hit"), F.avg(F.when(F.col("tot_templ_ct") > 0, F.col("tot_templ_ct"))).alias("nz_mean"),
        F.corr("fwd_templ_ct", "rev_templ_ct").alias("fr_corr"), F.corr("tot_rd_ct", "tot_templ_ct").alias("rt_corr"),
    )
    b = reads.agg(F.count("*").alias("total_reads"), F.count_if("kept").alias("trimmed_reads"), F.count_if(F.col("seq").contains(ADAPTER2)).alias("adapter_reads"), F.avg(F.when(F.col("kept"), F.length("insert"))).alias("mean_genomic"))
    one = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("density", F.col("sites_hit") / F.col("sites")).withColumn("ratio", F.col("read_count") / F.nullif("template_count", F.lit(0)))


def barseq_catalog(placed: DataFrame) -> DataFrame:
    """(site, barcode, n, popularity, good): barcodes at signed sites; a good one has one site and no X."""
    each = placed.groupBy("site", "barcode").agg(F.count("*").alias("n"))
    homes = each.groupBy("barcode").agg((F.count("*") == 1).alias("_one"))
    order = Window.partitionBy("site").orderBy(F.desc("n"), F.desc("barcode"))
    return each.join(homes, "barcode").withColumn("good", F.col("_one") & ~F.col("barcode").contains("X")).drop("_one").withColumn("popularity", F.row_number().over(order))


def dataset_stats(counts: DataFrame) -> DataFrame:
    """One row: sites, sites above 1, their share and mean, and the five highest counts."""
    many = F.when(F.col("count") > 1, F.col("count"))
    one = counts.agg(F.count("*").alias("sites"), F.count(many).alias("sites_hit"), F.avg((F.col("count") > 1).cast("double")).alias("density"), F.avg(many).alias("mean_hit"))
    top = counts.orderBy(F.desc("count")).limit(5).agg(F.reverse(F.array_sort(F.collect_list("count"))).alias("top5"))
    return one.withColumn("_k", F.lit(1)).join(top.withColumn("_k", F.lit(1)), "_k").drop("_k")


def barcode_counts(reads: DataFrame, guides: DataFrame) -> DataFrame:
    """(sgrna, count) for every guide: reads whose text between the constants is the reverse complement of the guide's barcode.

    Reads are counted by barcode before they meet the guides, so the join is small whatever the reads.
    """
    seen = extract_between(reads, GUIDE_BEFORE, GUIDE_AFTER, 10, 30, missing=None).filter("barcode IS NOT NULL").groupBy("barcode").agg(F.count("*").alias("count"))
    keyed = guides.withColumn("_bc", reverse_complement(F.col("barcode"))).select("sgrna", "_bc")
    return keyed.join(seen, keyed["_bc"] == seen["barcode"], "left").select("sgrna", F.coalesce("count", F.lit(0)).alias("count"))
