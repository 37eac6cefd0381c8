"""Multiple-testing corrections, runs and ranks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.ordered import before_ranges, in_order, placed, running, tidy
from lociq.scratch import keep


def bh_fdr(df: DataFrame, p: str = "pval", q: str = "padj", keys: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg q values; null and NaN p take no part and get a null q. Ties share the value.

    Distinct values with their counts are put in order by ranges: a value's rank is the running count up to it, and its q the
    least p n / rank from there on. df is written first, as it is read twice.
    """
    keys = keys or []
    named = keep(df.withColumn("_p", F.when(F.col(p).isNotNull() & ~F.isnan(p), F.col(p))), "tests")
    each = named.filter("_p IS NOT NULL").groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    laid = in_order(each, keys, ["_p"], "p-values")
    ranks = running(laid, keys, {"_rank": F.col("_c")})
    whole = laid.groupBy(*keys).agg(F.sum("_c").alias("_total"))
    same = [F.col(f"_t.{k}").eqNullSafe(F.col(f"_w.{k}")) for k in keys]
    sized = ranks.alias("_t").join(whole.alias("_w"), reduce(and_, same), "inner").select("_t.*", "_total") if keys else ranks.withColumn("_one", F.lit(0)).join(F.broadcast(whole.withColumn("_one", F.lit(0))), "_one")  # one row
    raw = sized.withColumn("_raw", F.col("_p") * F.col("_total") / F.col("_rank"))
    later = before_ranges(raw, keys, {"_later": ("min", F.min("_raw"))}, reverse=True)
    upto = Window.partitionBy("_range", *keys).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    best = F.least(F.min("_raw").over(upto), F.col("_later"), F.lit(1.0))  # least() skips nulls
    found = later.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_v"), best.alias(q))
    met = F.col("_p") == F.col("_v")
    for i, k in enumerate(keys):
        met &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return named.join(found, met, "left").drop("_p", "_v", *[f"_k{i}" for i in range(len(keys))])


def runs(sites: DataFrame, keys: list[str], empty: Column | None = None) -> DataFrame:
    """Runs of consecutive empty sites: (keys, run_id, length, start_idx, end_idx, start_pos, end_pos); indexes are 1-based.

    A run's number is that of the hits before it. A run over several ranges has one number in all of them, and is put together by it.
    """
    empty = F.col("count") == 0 if empty is None else empty
    laid = placed(in_order(sites.select(*keys, "position", empty.alias("_empty")), keys, ["position"], "sites"), keys, "_idx")
    marked = running(laid, keys, {"run_id": F.when(F.col("_empty"), 0).otherwise(1)})
    return marked.filter("_empty").groupBy(*keys, "run_id").agg(
        F.count("*").alias("length"), F.min("_idx").alias("start_idx"), F.max("_idx").alias("end_idx"), F.min("position").alias("start_pos"), F.max("position").alias("end_pos"))


def gene_runs(tosses: DataFrame, empty: Column) -> DataFrame:
    """runs() within each gene, by a window over its sites."""
    order = Window.partitionBy("orf").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    marked = tosses.select("orf", "position", empty.alias("_empty"), F.sum(F.when(empty, 0).otherwise(1)).over(order).alias("run_id"))
    return marked.filter("_empty").groupBy("orf", "run_id").agg(F.count("*").alias("length"), F.min("position").alias("start_pos"), F.max("position").alias("end_pos"))


def state_runs(sites: DataFrame, keys: list[str], run_length: int = 6, min_count: float = 2) -> DataFrame:
    """Sites with state ES in a run of run_length or more sites below min_count, otherwise NE."""
    low = F.col("count") < min_count
    marked = keep(tidy(running(in_order(sites, keys, ["position"], "sites"), keys, {"_island": F.when(low, 0).otherwise(1)})), "islands")
    long_runs = marked.filter(low).groupBy(*keys, "_island").agg(F.count("*").alias("_size")).filter(F.col("_size") >= run_length)
    return marked.join(long_runs, [*keys, "_island"], "left").withColumn("state", F.when(low & F.col("_size").isNotNull(), "ES").otherwise("NE")).drop("_island", "_size").select(*sites.columns, "state")


def local_average(sites: DataFrame, keys: list[str], width: int = 5, pseudo: float = 10.0, block: int = 10_000) -> DataFrame:
    """Mean count of the neighbours with the same state, `width` on each side, itself left out; -1 if there is none; and the LFC to it.

    A window sees one block of sites and `width` more on either side of it.
    """
    numbered = placed(in_order(sites, keys, ["position"], "sites"), keys)
    own_block = F.expr(f"(_n - 1) div {block}L")
    near_blocks = F.array_distinct(F.array(own_block, F.expr(f"(_n - 1 - {width}) div {block}L"), F.expr(f"(_n - 1 + {width}) div {block}L")))
    dealt = numbered.withColumn("_own", own_block).withColumn("_block", F.explode(near_blocks))
    near = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(-width, width)
    own = F.col("state") == "ES"
    n = F.when(own, F.sum(own.cast("int")).over(near)).otherwise(F.sum((~own).cast("int")).over(near)) - 1
    total = F.when(own, F.sum(F.when(own, F.col("count")).otherwise(0)).over(near)).otherwise(F.sum(F.when(own, 0).otherwise(F.col("count"))).over(near)) - F.col("count")
    met = dealt.withColumns({"_m": n, "_s": total}).filter("_block = _own").withColumn("local_mean", F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).otherwise(-1.0))
    return met.withColumn("local_lfc", F.log2((F.col("count") + pseudo) / (F.col("local_mean") + pseudo))).select(*sites.columns, "local_mean", "local_lfc")


def rank_scores(results: DataFrame, ranking: str = "SLPV", seed: int | None = 0) -> DataFrame:
    """Genes ranked by signed log p or by LFC, descending; ties in the order of a seeded hash, or by gene where seed is None."""
    score = F.signum("lfc") * F.log10(F.col("pval") + 1e-6) if ranking == "SLPV" else F.col("lfc")
    tie = F.col("orf") if seed is None else F.xxhash64("orf", F.lit(seed))
    laid = in_order(results.withColumn("score", score).withColumn("_tie", tie), [], [F.desc("score"), "_tie"], "scores")
    return tidy(placed(laid, [], "rank")).drop("_tie").withColumn("rank", F.col("rank").cast("int"))


def running_enrichment(ranked: DataFrame, members: DataFrame, p: float = 0.0) -> DataFrame:
    """(term, es, n_members): the largest gap between hit weight and miss fraction along the ranks.

    A term whose members all weigh 0 has an es of 0; a term that holds every gene has no misses, and their fraction is 0.
    """
    n = ranked.agg(F.count("*").alias("n_genes"))
    hits = members.distinct().join(ranked.select("orf", "rank", "score"), "orf")
    sized = hits.withColumns({"_w": F.pow(F.abs("score"), F.lit(p)), "_size": F.count("*").over(Window.partitionBy("term"))})
    upto = Window.partitionBy("term").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.sum("_w").over(upto) / F.nullif(F.sum("_w").over(Window.partitionBy("term")), F.lit(0.0))
    miss = (F.col("rank") - F.row_number().over(upto.rowsBetween(Window.unboundedPreceding, 0))) / F.nullif(F.lit(n.first()[0]) - F.col("_size"), F.lit(0))
    gap = F.when(hit.isNull(), 0.0).otherwise(F.abs(hit - F.coalesce(miss, F.lit(0.0))))
    return sized.withColumn("_gap", gap).groupBy("term").agg(F.max("_gap").alias("es"), F.max("_size").alias("n_members"))


def _running_mean(df: DataFrame, value: str, name: str) -> DataFrame:
    laid = placed(in_order(df, [], [value, "orf"], "probabilities"), [])
    return tidy(running(laid, [], {name: F.col(value)}).withColumn(name, F.col(name) / F.col("_n"))).drop("_n")


def bfdr(df: DataFrame, p: str = "prob_null") -> DataFrame:
    """Running mean of the sorted null probabilities."""
    return _running_mean(df, p, "bfdr")


def fwer_bayes(df: DataFrame, p: str = "prob_null") -> DataFrame:
    """1 less the running product of 1 - p over the sorted null probabilities."""
    laid = in_order(df, [], [p, "orf"], "probabilities")
    return tidy(running(laid, [], {"fwer": F.log1p(-F.least(F.col(p), F.lit(1 - 1e-12)))}).withColumn("fwer", 1 - F.exp("fwer")))


def running_locfdr(df: DataFrame, fdr: str = "locfdr") -> DataFrame:
    return _running_mean(df, fdr, "ebfdr")


def trimmed_mean(values: DataFrame, keys: list[str], value: str, trim: float) -> DataFrame:
    """(keys, trimmed_mean): the mean without int(n * trim) values at either end.

    Values are first counted, so the window runs over distinct values and not over rows.
    """
    each = values.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.floor(F.sum("_c").over(whole) * trim)
    end = F.sum("_c").over(upto)
    ranged = each.withColumns({"_n": F.sum("_c").over(whole), "_cut": cut, "_end": end})
    used = F.greatest(F.least(F.col("_end"), F.col("_n") - F.col("_cut")) - F.greatest(F.col("_end") - F.col("_c"), F.col("_cut")), F.lit(0))
    return ranged.groupBy(*keys).agg((F.sum(F.col(value) * used) / F.sum(used)).alias("trimmed_mean"))


def average_ranks(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with avg_rank (ties averaged) and ties, the size of the row's tie."""
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return values.withColumn("ties", ties).withColumn("avg_rank", F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.col("ties") - 1) / 2)


def tie_counts(x: np.ndarray, gene: np.ndarray, starts: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Of some genes at a time: which pairs and genes these are, the place of each count of x [pair, sample] among the distinct ones, and how often a gene has each [gene, distinct].

    A table of a gene and distinct count has about `most` entries, or is that of one gene.
    """
    distinct, code = np.unique(x, return_inverse=True)
    code, ends = code.reshape(x.shape), np.r_[starts[1:], len(x)]
    step = max(most // len(distinct), 1)
    for first in range(0, len(starts), step):
        genes = slice(first, min(first + step, len(starts)))
        pairs = slice(starts[first], ends[genes.stop - 1])
        own = code[pairs]
        flat = ((gene[pairs] - first)[:, None] * len(distinct) + own).ravel()
        yield pairs, genes, own, np.bincount(flat, minlength=(genes.stop - first) * len(distinct)).reshape(-1, len(distinct))


def ranked_counts(x: np.ndarray, gene: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """average_ranks() of a gene's counts of all samples, for changed_over_genes()."""
    ranks = np.empty(x.shape)
    for pairs, genes, code, times in tie_counts(x, gene, starts):
        ranks[pairs] = (np.cumsum(times, axis=1) - (times - 1) / 2)[(gene[pairs] - genes.start)[:, None], code]
    return ranks


def essentiality_thresholds(posteriors: DataFrame, z: str = "zbar", alpha: float = 0.05) -> DataFrame:
    """One row (lower, upper): cut-offs on sorted posterior means that hold the false discovery rate.

    upper: the first z, from the largest, at rank i >= 3 with (1 - z) - mean(1 - the larger ones but one) > alpha i / n;
    lower: from the smallest, the first where alpha i / n > z - mean(the smaller ones).
    """
    values = placed(in_order(posteriors.filter(F.col(z) >= 0).select(F.col(z).alias("z"), "orf"), [], ["z", "orf"], "posteriors"), [], "j")
    summed = keep(tidy(running(values, [], {"upto": F.col("z")})), "posteriors-summed")
    whole = summed.agg(F.count("*").alias("n"), F.sum("z").alias("whole"))
    n = F.col("n")
    # From the largest down, rank i is place n + 1 - j from below; the i - 2 rows above the one before it stand from place j + 2 on.
    seen = summed.join(summed.select((F.col("j") - 1).alias("j"), F.col("upto").alias("next")), "j", "left").withColumn("_one", F.lit(0)).join(F.broadcast(whole.withColumn("_one", F.lit(0))), "_one").withColumn("i", n + 1 - F.col("j"))  # one row
    above = 1 - (F.col("whole") - F.col("next")) / F.nullif(F.col("i") - 2, F.lit(0))
    below = (F.col("upto") - F.col("z")) / F.nullif(F.col("j") - 1, F.lit(0))
    high = F.when((F.col("i") >= 3) & ((1 - F.col("z")) - above > alpha * F.col("i") / n), F.struct("i", "z"))
    low = F.when((F.col("j") >= 2) & (F.col("z") - below > alpha * F.col("j") / n), F.struct("j", "z"))
    return seen.agg(F.coalesce(F.min(low)["z"], F.lit(0.0)).alias("lower"), F.coalesce(F.min(high)["z"], F.lit(1.0)).alias("upper"))


def bucket_sums(sites: DataFrame, keys: list[str], width: int = 100) -> DataFrame:
    """Counts per `width` consecutive sites, with the first position of each bucket."""
    numbered = placed(in_order(sites.select(*keys, "position", "count"), keys, ["position"], "sites"), keys).withColumn("_bucket", F.expr(f"(_n - 1) div {width}L"))
    return numbered.groupBy(*keys, F.col("_bucket").alias("bucket")).agg(F.min("position").alias("position"), F.sum("count").alias("count"))
