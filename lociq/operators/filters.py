"""Sample, condition, site and gene filters (DataFrame in, DataFrame out)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_only(site_counts: DataFrame, samples: DataFrame, conditions=None, fingerprints=None, ids=None) -> DataFrame:
    """Counts of the samples that meet all given restrictions; no such sample is an error that lists what there is."""
    kept = samples
    for column, wanted in (("condition", conditions), ("filename", fingerprints), ("sample_id", ids)):
        if wanted is not None:
            kept = kept.filter(F.col(column).isin(list(wanted)))
    if kept.isEmpty():
        raise ValueError(f"no sample is left; there are {[r.asDict() for r in samples.select('sample_id', 'condition').limit(50).collect()]}")
    return site_counts.join(kept.select("sample_id"), "sample_id", "left_semi")


def filter_by_conditions(samples: DataFrame, include=(), exclude=()) -> DataFrame:
    """Samples whose condition is included, or is not excluded; both lists at once are an error. Unmapped samples go."""
    if include and exclude:
        raise ValueError("give conditions to include or to exclude, not both")
    kept = samples.filter(F.col("condition").isNotNull())
    if include:
        return kept.filter(F.col("condition").isin(list(include)))
    return kept.filter(~F.col("condition").isin(list(exclude))) if exclude else kept


def regroup_conditions(samples: DataFrame, group_by: str, include=(), exclude=(), covars=(), interactions=()) -> DataFrame:
    """Filter on the original condition, and return another column as the group, with covariates and interactions."""
    kept = samples.filter(F.col("condition").isin(list(include))) if include else samples
    kept = kept.filter(~F.col("condition").isin(list(exclude))) if exclude else kept
    return kept.select("sample_id", F.col(group_by).alias("condition"), *covars, *interactions)


def select_conditions(samples: DataFrame, include=(), exclude=()) -> DataFrame:
    """(condition, rank): the order given by include, or that of first appearance, less those excluded."""
    seen = samples.groupBy("condition").agg(F.min("condition_order").alias("first_seen"))
    if include:
        seen = seen.filter(F.col("condition").isin(list(include)))
        key = F.array_position(F.array(*[F.lit(c) for c in include]), F.col("condition"))
    else:
        key = F.col("first_seen")
    if exclude:
        seen = seen.filter(~F.col("condition").isin(list(exclude)))
    return seen.select("condition", F.row_number().over(Window.orderBy(key)).alias("rank"))  # as many rows as conditions


def lookup(samples: DataFrame, want: str, **given) -> DataFrame:
    """Distinct values of one metadata column for rows that match all given columns."""
    kept = samples
    for column, value in given.items():
        kept = kept.filter(F.col(column) == value)
    return kept.select(want).distinct()


def min_read_filter(site_counts: DataFrame, minread: float) -> DataFrame:
    return site_counts.withColumn("count", F.when(F.col("count") < minread, 0.0).otherwise(F.col("count")))


def winsorize(blocks: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """In each block the largest value becomes the second-largest distinct one; blocks with one distinct value stay."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(count)))
    ranked = blocks.withColumn("_rank", rank)
    second = F.max(F.when(F.col("_rank") == 2, F.col(count))).over(Window.partitionBy(*keys))
    return ranked.withColumn(count, F.when((F.col("_rank") == 1) & second.isNotNull(), second).otherwise(F.col(count))).drop("_rank")


def _below_largest(x: np.ndarray, gene: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which counts are the largest of their gene and sample, how many these are [gene, sample], and the largest of the others, -inf if there is none."""
    largest = x == np.maximum.reduceat(x, starts, axis=0)[gene]
    return largest, np.add.reduceat(largest, starts, axis=0, dtype=np.int64), np.maximum.reduceat(np.where(largest, -np.inf, x), starts, axis=0)


def winsorized(x: np.ndarray, gene: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """winsorize() of each gene and sample, for changed_over_genes()."""
    largest, _, second = _below_largest(x, gene, starts)
    return np.where(largest & np.isfinite(second)[gene], second[gene], x)


def winsorized_resampling(x: np.ndarray, gene: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """winsorize_resampling() of each gene and sample, for changed_over_genes(): a largest count that is there twice is its own second."""
    largest, times, second = _below_largest(x, gene, starts)
    use = (times == 1) & (np.diff(np.r_[starts, len(x)]) >= 3)[:, None] & (second != 0)
    return np.where(largest & use[gene], second[gene], x)


def winsorize_resampling(blocks: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Values equal to the largest become the second value in sorted order, duplicates counted; no change below three values or if it is 0."""
    at = Window.partitionBy(*keys)
    numbered = blocks.withColumn("_n", F.row_number().over(at.orderBy(F.desc(count))))
    second = F.max(F.when(F.col("_n") == 2, F.col(count))).over(at)
    use = (F.count("*").over(at) >= 3) & (second != 0) & (F.col(count) == F.max(count).over(at))
    return numbered.withColumn(count, F.when(use, second).otherwise(F.col(count))).drop("_n")


def remove_empty_regions(site_counts: DataFrame, longest: int, keys: list[str] | None = None) -> DataFrame:
    """Sites less those in runs of `longest` or more empty sites."""
    keys = keys or ["sample_id", "contig"]
    order = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    marked = site_counts.withColumn("_run", F.sum(F.when(F.col("count") == 0, 0).otherwise(1)).over(order))
    size = F.count_if(F.col("count") == 0).over(Window.partitionBy(*keys, "_run"))
    return marked.withColumn("_size", size).filter(~((F.col("count") == 0) & (F.col("_size") >= longest))).drop("_run", "_size")


def cross_product_counts(samples: DataFrame, variables: list[str]) -> DataFrame:
    """How many samples each combination of the variables' values has, empty combinations included.

    The values come from metadata: their lists are arrays on each row, and no join multiplies rows.
    """
    lists = samples.agg(*[F.array_sort(F.collect_set(v)).alias(v) for v in variables])
    for v in variables:
        lists = lists.withColumn(v, F.explode(v))
    found = samples.groupBy(*variables).agg(F.count("*").alias("n_samples"))
    return lists.join(found, variables, "left").fillna(0, ["n_samples"])


def significant_rows(results: DataFrame, q: float = 0.05, topk: int = -1, low_mean: float = 0.0) -> DataFrame:
    """Rows with padj < q, or with topk the first k by padj whatever it is; then low means go."""
    if topk < 0:
        kept = results.filter(F.col("padj") < q)
    else:
        kept = results.orderBy("padj", "orf").limit(topk)
    return kept.filter(F.round(F.col("mean_of_means"), 1) >= low_mean)


def enrichment_filters(results: DataFrame, topk: int = -1, q: float = 0.05, focus: str | None = None, min_lfc: float | None = None) -> DataFrame:
    """Hits: the first topk by padj or those below q, of the wanted sign of LFC, and of its size."""
    hits = results.orderBy("padj", "orf").limit(topk) if topk > 0 else results.filter(F.col("padj") < q)
    if focus is not None:
        hits = hits.filter(F.col("lfc") > 0 if focus == "pos" else F.col("lfc") < 0)
    return hits.filter(F.abs("lfc") > min_lfc) if min_lfc is not None else hits


def transposon_type(site_counts: DataFrame) -> DataFrame:
    """(sample_id, has_zero_sites, transposon): consecutive coordinates mean tn5, otherwise himar1."""
    before = F.lag("position").over(Window.partitionBy("sample_id", "contig").orderBy("position"))
    marked = site_counts.withColumn("_next", F.coalesce(before + 1 == F.col("position"), F.lit(False)))
    return marked.groupBy("sample_id").agg(
        F.bool_or(F.col("count") == 0).alias("has_zero_sites"), F.when(F.bool_or("_next"), "tn5").otherwise("himar1").alias("transposon"))


def unsupported_transposons(site_counts: DataFrame, supported: list[str]) -> DataFrame:
    types = transposon_type(site_counts).agg(F.collect_set("transposon").alias("found"))
    return types.select(F.array_sort(F.array_except("found", F.array(*[F.lit(x) for x in supported]))).alias("unsupported"))


def bounds_predicate(ignore_codon: bool, n_terminus: float, c_terminus: float, variant: str = "A") -> Column:
    """Whether `position` counts for a gene with columns start, end and strand.

    Variant A: stop codon off by strand, then fractions of the whole span. Variant B: fractions of the span without the stop codon.
    """
    pos, start, end, plus = F.col("position"), F.col("start"), F.col("end"), F.col("strand") == "+"
    if variant == "A":
        inside = pos.between(start, end)
        if ignore_codon:
            inside &= F.when(plus, pos <= end - 3).otherwise(pos >= start + 3)
    else:
        start, end = (F.when(plus, start).otherwise(start + 3), F.when(plus, end - 3).otherwise(end)) if ignore_codon else (start, end)
        inside = pos.between(start, end)
    part = (pos - start) / F.nullif(end - start, F.lit(0))
    return inside & F.coalesce((part >= n_terminus / 100) & (part <= 1 - c_terminus / 100), F.lit(n_terminus == 0))
