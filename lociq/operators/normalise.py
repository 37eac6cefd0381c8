"""Whole-sample normalisation: factors per sample, joined back and multiplied."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators.joins import small
from lociq.operators.windows import bucket_sums, trimmed_mean

METHODS = ("nonorm", "TTR", "nzmean", "totreads", "zinfnb", "quantile", "betageom", "aBGC", "emphist", "target")


def scaled(site_counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Counts times their sample's factor; factors has a row a sample. A sample without hits has no factor and keeps its zeros."""
    return site_counts.join(small(factors), "sample_id", "left").withColumn("count", F.col("count") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def ttr_factors(site_counts: DataFrame, trim: float = 0.05, density: Column | None = None, mean: Column | None = None, target: float = 100.0) -> DataFrame:
    """target / (density * trimmed mean of the non-zero counts); null without hits.

    density and mean may be other estimators: aggregates over a sample's rows (position, count).
    """
    density = F.avg((F.col("count") > 0).cast("double")) if density is None else density
    share = site_counts.groupBy("sample_id").agg(density.alias("_d"), (F.lit(None).cast("double") if mean is None else mean).alias("trimmed_mean"))
    if mean is None:
        share = share.drop("trimmed_mean").join(trimmed_mean(site_counts.filter("count > 0"), ["sample_id"], "count", trim), "sample_id", "left")
    return share.select("sample_id", (target / F.nullif(F.col("_d") * F.col("trimmed_mean"), F.lit(0.0))).alias("factor"))


def _to_grand_mean(site_counts: DataFrame, mean: Column) -> DataFrame:
    """The mean of the samples' means over each one's own; samples without hits take no part and get null."""
    each = site_counts.groupBy("sample_id").agg(F.nullif(mean, F.lit(0.0)).alias("_m"))
    return each.select("sample_id", (F.avg("_m").over(Window.partitionBy()) / F.col("_m")).alias("factor"))  # a row a sample


def nzmean_factors(site_counts: DataFrame) -> DataFrame:
    return _to_grand_mean(site_counts, F.avg(F.when(F.col("count") > 0, F.col("count"))))


def totreads_factors(site_counts: DataFrame) -> DataFrame:
    return _to_grand_mean(site_counts, F.avg("count"))


def target_factors(site_counts: DataFrame, target: float = 100.0) -> DataFrame:
    return site_counts.groupBy("sample_id").agg((target / F.nullif(F.avg("count"), F.lit(0.0))).alias("factor"))


def zinfnb_factors(site_counts: DataFrame) -> DataFrame:
    """1 / mu of a zero-inflated negative binomial fitted to each sample's histogram of counts."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, w = rows["count"].to_numpy(float), rows["n"].to_numpy(float)
        pi, r, mu = fit_zinb(np.rint(x), w) if x.max() > 0 else (1.0, 1.0, 1.0)  # no hits: a factor of 1
        return pd.DataFrame({"sample_id": [rows["sample_id"].iloc[0]], "factor": [1 / max(mu, 1e-9)], "pi": [pi], "r": [r]})

    histogram = site_counts.groupBy("sample_id", "count").agg(F.count("*").alias("n"))
    return histogram.groupBy("sample_id").applyInPandas(fit, "sample_id string, factor double, pi double, r double").select("sample_id", "factor")


def fit_zinb(x: np.ndarray, w: np.ndarray, steps: int = 200) -> tuple[float, float, float]:
    """Zero share, size and mean of a zero-inflated negative binomial, by EM over distinct counts with weights."""
    from lociq.functions.special import lgamma

    zero, total = x == 0, w.sum()
    mu, pi, r = max((x * w).sum() / max(w[~zero].sum(), 1), 1e-6), 0.5 * w[zero].sum() / total, 1.0
    grid = np.exp(np.linspace(np.log(1e-2), np.log(1e3), 60))
    for step in range(steps):
        p0 = (r / (r + mu)) ** r
        share = np.where(zero, pi / max(pi + (1 - pi) * p0, 1e-300), 0.0)  # that a zero is an extra one
        v = w * (1 - share)
        before = (pi, r, mu)
        pi, mu = (w * share).sum() / total, (v * x).sum() / max(v.sum(), 1e-300)
        if step % 5 == 0:
            s = grid[:, None]
            like = (v * (lgamma(x + s) - lgamma(s) + s * np.log(s / (s + mu)) + x * np.log(mu / (s + mu)))).sum(1)
            r = float(grid[like.argmax()])
        if step % 5 and max(abs(a - b) for a, b in zip(before, (pi, r, mu))) < 1e-9 * max(1, mu):
            break
    return float(pi), float(r), float(mu)


def emphist_factors(site_gene: DataFrame, reference: str, points: int = 50_000) -> DataFrame:
    """exp(-peak) of the density of log ratios of gene sums to the reference sample; genes need reads in both."""
    sums = site_gene.groupBy("sample_id", "orf").agg(F.sum("count").alias("s")).filter("s > 0")
    ref = sums.filter(F.col("sample_id") == reference).select("orf", F.col("s").alias("_r"))
    ratios = sums.join(ref, "orf").select("sample_id", F.log(F.col("s") / F.col("_r")).alias("ratio"))

    def peak(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["ratio"].to_numpy()
        sd = x.std()
        if sd < 1e-12:
            return pd.DataFrame({"sample_id": [rows["sample_id"].iloc[0]], "factor": [float(np.exp(-x.mean()))]})
        at = np.linspace(x.mean() - 5 * sd, x.mean() + 5 * sd, points)
        width = x.std(ddof=1) * len(x) ** -0.2
        cell = np.bincount(np.clip(np.rint((x - at[0]) / (at[1] - at[0])).astype(int), 0, points - 1), minlength=points)
        reach = int(np.ceil(5 * width / (at[1] - at[0])))
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * (at[1] - at[0]) / width) ** 2)
        size = 1 << int(np.ceil(np.log2(points + len(kernel))))
        density = np.fft.irfft(np.fft.rfft(cell, size) * np.fft.rfft(kernel, size), size)[reach : reach + points]
        return pd.DataFrame({"sample_id": [rows["sample_id"].iloc[0]], "factor": [float(np.exp(-at[density.argmax()]))]})

    return ratios.groupBy("sample_id").applyInPandas(peak, "sample_id string, factor double")


def quantile(site_counts: DataFrame) -> DataFrame:
    """The value at dense rank r of a sample becomes the r-th distinct value of the means of the sorted columns."""
    order = Window.partitionBy("sample_id").orderBy("count", "position")
    ranked = site_counts.withColumn("_n", F.row_number().over(order)).withColumn("_r", F.dense_rank().over(Window.partitionBy("sample_id").orderBy("count")))
    means = ranked.groupBy("_n").agg(F.avg("count").alias("_m")).select("_m").distinct()
    # Distinct means are few beside rows: as few as distinct columns of sorted values.
    means = means.withColumn("_r", F.dense_rank().over(Window.orderBy("_m")))
    return ranked.join(means, "_r").select("sample_id", "contig", "position", F.col("_m").alias("count"))


def betageom(site_counts: DataFrame, nonzero_only: bool = False, trims: tuple[float, ...] = (0.001,), draws: int = 200_000, seed: int = 0) -> DataFrame:
    """Counts mapped from a fitted beta-geometric to the geometric of the same mean, by distinct count, then TTR.

    With several trims (aBGC, on non-zero counts) each sample takes the one whose mapped counts are closest to the geometric.
    """

    def correct(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["sample_id"].iloc[0]
        x, w = rows["count"].to_numpy(float), rows["n"].to_numpy(float)
        order = np.argsort(x)
        x, w = x[order], w[order]
        n, end = w.sum(), np.cumsum(w)
        mean = (x * w).sum() / n
        if mean == 0:
            return pd.DataFrame({"sample_id": name, "count": x, "mapped": x})
        middle = (end - w / 2) / n
        log_tail = np.log1p(-np.minimum(middle, 1 - 0.5 / n))
        best = None
        for trim in trims:
            cut = np.floor(n * trim)
            used = np.maximum(np.minimum(end, n - cut) - np.maximum(end - w, cut), 0)
            rho = max(1 / max(((x + 1) * used).sum() / max(used.sum(), 1), 1e-9), 1e-4)
            a = (w * log_tail**2).sum() / min((w * x * log_tail).sum(), -1e-9)
            k = max((2 * np.exp(a) - 1) / max(np.exp(a) + rho - 1, 1e-9), 10.0)
            rng = np.random.default_rng(seed)
            sample = np.sort(rng.geometric(np.clip(rng.beta(k * rho, k * (1 - rho), draws), 1e-9, 1)))
            share = np.clip(np.searchsorted(sample, np.maximum(x, 1), "right") / draws, 0, 1 - 1 / (draws + 1))
            p = 1 / max(mean, 1 + 1e-9)
            mapped = np.where(x > 0, np.ceil(np.log1p(-share) / np.log1p(-p)), 0.0)
            want = 1 - (1 - p) ** np.maximum(mapped, 0)
            score = (np.abs(middle - want) ** 2 / np.maximum(want * (1 - want), 1e-9)).max()
            if best is None or score < best[0]:
                best = (score, mapped)
        return pd.DataFrame({"sample_id": name, "count": x, "mapped": best[1]})

    used = site_counts.filter("count > 0") if nonzero_only else site_counts
    table = used.groupBy("sample_id", "count").agg(F.count("*").alias("n")).groupBy("sample_id").applyInPandas(correct, "sample_id string, count double, mapped double")
    mapped = site_counts.join(table, ["sample_id", "count"], "left").withColumn("count", F.coalesce("mapped", F.lit(0.0))).drop("mapped")
    return scaled(mapped, ttr_factors(mapped))


def loess_correction(site_counts: DataFrame, h: float = 10_000, window: int = 100, weighted: bool = False) -> DataFrame:
    """Counts divided by a local linear trend along the genome, scaled to mean 1.

    The trend is fitted at bucket starts: buckets meet those of the neighbouring stretches of length h by an equi-join.
    """
    sums = bucket_sums(site_counts, ["sample_id", "contig"], window)
    left = sums.withColumn("_s", F.floor(F.col("position") / h))
    right = sums.select("sample_id", "contig", F.col("position").alias("x"), F.col("count").alias("y"), F.explode(F.array(*[F.floor(F.col("position") / h) + k for k in (-1, 0, 1)])).alias("_s"))
    d = F.abs(F.col("x") - F.col("position")) / h
    near = left.join(right, ["sample_id", "contig", "_s"]).filter(d <= 1).withColumn("w", F.pow(1 - F.pow(d, F.lit(3.0)), F.lit(3.0)))
    square = F.sum(F.col("w") * F.col("x") * F.col("x")) if weighted else F.sum(F.col("x") * F.col("x").cast("double"))
    fit = near.groupBy("sample_id", "contig", "bucket", "position").agg(
        F.sum("w").alias("sw"), F.sum(F.expr("w * x")).alias("swx"), F.sum(F.expr("w * y")).alias("swy"), F.sum(F.expr("w * x * y")).alias("swxy"), square.alias("sxx"))
    fit = fit.withColumn("slope", F.expr("(sw * swxy - swx * swy) / nullif(sw * sxx - swx * swx, 0)")).withColumn("smooth", F.expr("(swy - coalesce(slope, 0) * swx) / sw + coalesce(slope, 0) * position"))
    fit = fit.withColumn("factor", F.col("smooth") / F.nullif(F.avg("smooth").over(Window.partitionBy("sample_id", "contig")), F.lit(0.0)))
    numbered = site_counts.withColumn("bucket", F.floor((F.row_number().over(Window.partitionBy("sample_id", "contig").orderBy("position")) - 1) / window))
    return numbered.join(fit.select("sample_id", "contig", "bucket", "factor"), ["sample_id", "contig", "bucket"]).withColumn("count", F.coalesce(F.col("count") / F.nullif("factor", F.lit(0.0)), "count")).drop("bucket", "factor")


def empirical_theta(site_counts: DataFrame) -> DataFrame:
    return site_counts.groupBy("sample_id").agg(F.avg((F.col("count") > 0).cast("double")).alias("theta"))


def trimmed_empirical_mu(site_counts: DataFrame, trim: float = 0.05) -> DataFrame:
    return trimmed_mean(site_counts.filter("count > 0"), ["sample_id"], "count", trim).withColumnRenamed("trimmed_mean", "mu")


def normalize(site_counts: DataFrame, method: str = "TTR", site_gene: DataFrame | None = None, reference: str | None = None, target: float = 100.0) -> DataFrame:
    """Normalised counts; an unknown method leaves them as they are, as the command line warns. A sample without hits keeps its zeros under every method but quantile, which ranks it with the others."""
    factors = {"TTR": ttr_factors, "nzmean": nzmean_factors, "totreads": totreads_factors, "zinfnb": zinfnb_factors}
    if method in factors:
        return scaled(site_counts, factors[method](site_counts))
    if method == "target":
        return scaled(site_counts, target_factors(site_counts, target))
    if method == "emphist":
        return scaled(site_counts, emphist_factors(site_gene, reference))
    if method == "quantile":
        return quantile(site_counts)
    if method == "betageom":
        return betageom(site_counts)
    if method == "aBGC":
        return betageom(site_counts, True, tuple(i / 50 for i in range(16)))
    return site_counts
