"""CRISPRi dose response: abundances, regression over doses, local false discovery."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions import special
from lociq.operators.joins import with_metadata
from lociq.operators.windows import bh_fdr, running_locfdr


def extract_abundance(counts: DataFrame, samples: DataFrame, drug: str, days: int, control: str = "DMSO") -> DataFrame:
    """(sgrna, sample, dose, fraction) of the drug's and control's samples of one day; a sample's counts sum to 1."""
    kept = samples.filter(F.col("drug").isin(drug, control) & (F.col("days") == days)).withColumn("dose", F.when(F.col("drug") == control, 0.0).otherwise(F.col("dose")))
    joined = with_metadata(counts, kept.select("sample", "dose"), "sample")
    return joined.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy("sample")))


def relative_abundance(fractions: DataFrame, uninduced: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Fractions over the guide's uninduced fraction."""
    return fractions.join(uninduced, "sgrna").withColumn("abundance", (F.col("fraction") + eps) / (F.col("uninduced") + eps))


def estimated_uninduced(counts: DataFrame, pseudo: float = 1e-8) -> DataFrame:
    """(sgrna, uninduced) without uninduced samples, from the counts (sgrna, sample, dose, count) of all samples: a guide's mean at
    dose 0 times exp(2 (sd + pc) / (mean + pc)), sd and mean over all its samples, as shares that sum to 1.

    A guide with one sample has a deviation of 0; one without a sample at dose 0 gets 0.
    """
    each = counts.groupBy("sgrna").agg(F.avg("count").alias("m"), F.coalesce(F.stddev_samp("count"), F.lit(0.0)).alias("s"), F.coalesce(F.avg(F.when(F.col("dose") == 0, F.col("count"))), F.lit(0.0)).alias("m0"))
    raw = each.withColumn("_u", F.col("m0") * F.exp(2 * (F.col("s") + pseudo) / (F.col("m") + pseudo)))
    return raw.select("sgrna", F.coalesce(F.col("_u") / F.nullif(F.sum("_u").over(Window.partitionBy()), F.lit(0.0)), F.lit(0.0)).alias("uninduced"))  # a row a guide


def dose_response(points: DataFrame) -> DataFrame:
    """Least squares per gene of logit10(0.01 + 0.99 tanh(abundance)) on efficacy and log2 dose, from sums: points is (orf, efficacy, dose, abundance).

    (orf, n, intercept, coef_efficacy, coef_dose, p_…, padj, z). Dose 0 counts as half the smallest positive dose. Genes whose design has no inverse get nulls.
    """
    least = points.filter("dose > 0").agg(F.min("dose").alias("d")).first()["d"] or 1.0
    squashed = F.lit(0.01) + 0.99 * F.tanh("abundance")
    p = points.select("orf", F.col("efficacy").alias("a"), F.log2(F.when(F.col("dose") == 0, least / 2).otherwise(F.col("dose"))).alias("b"), F.log10(squashed / (1 - squashed)).alias("y"))
    mean = p.groupBy("orf").agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("y").alias("my"))
    c = p.join(mean, "orf").select("orf", "n", "ma", "mb", "my", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"), (F.col("y") - F.col("my")).alias("y"))
    s = c.groupBy("orf", "n", "ma", "mb", "my").agg(*[F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in ("aa", "ab", "bb", "ay", "by", "yy")])
    det = F.nullif(F.when(F.expr("aa * bb - ab * ab") > 1e-12 * F.greatest(F.expr("aa * bb"), F.lit(1e-300)), F.expr("aa * bb - ab * ab")), F.lit(0.0))
    s = s.withColumn("det", det).withColumn("coef_efficacy", F.expr("(bb * ay - ab * by) / det")).withColumn("coef_dose", F.expr("(aa * by - ab * ay) / det")).withColumn("intercept", F.expr("my - coef_efficacy * ma - coef_dose * mb"))
    s = s.withColumn("sigma2", F.expr("greatest(yy - coef_efficacy * ay - coef_dose * by, 0) / nullif(n - 3, 0)"))
    df = (F.col("n") - 3).cast("double")
    s = s.withColumn("p_dose", special.t_sf2_column(F.expr("coef_dose / nullif(sqrt(sigma2 * aa / det), 0)"), df)).withColumn("p_efficacy", special.t_sf2_column(F.expr("coef_efficacy / nullif(sqrt(sigma2 * bb / det), 0)"), df))
    s = bh_fdr(s, "p_dose", "padj")
    whole = Window.partitionBy()
    return s.withColumn("z", (F.col("coef_dose") - F.avg("coef_dose").over(whole)) / F.stddev_pop("coef_dose").over(whole)).select("orf", "n", "intercept", "coef_efficacy", "coef_dose", "p_efficacy", "p_dose", "padj", "z")


def significant_interactions(fits: DataFrame, negatives: DataFrame | None = None, q: float = 0.05, z: float = 2.0) -> DataFrame:
    """Hits by padj and by |z| from negative controls, or by running local false discovery."""
    if negatives is not None:
        one = negatives.agg(F.avg("coef_dose").alias("m"), F.stddev_pop("coef_dose").alias("s")).first()
        fits = fits.withColumn("z", (F.col("coef_dose") - one["m"]) / max(one["s"] or 0.0, 1e-12))
        return fits.withColumn("significant", (F.col("padj") < q) & (F.abs("z") > z))
    scored = running_locfdr(local_fdr(fits))
    return scored.withColumn("significant", (F.col("padj") < q) & (F.col("ebfdr") < q))


def local_fdr(fits: DataFrame, bins: int = 120, degree: int = 7) -> DataFrame:
    """Local false discovery rates of z, clipped to 10: a Poisson polynomial fit to the histogram against a normal null fitted to the centre."""
    clipped = fits.withColumn("_z", F.greatest(F.least("z", F.lit(10.0)), F.lit(-10.0)))
    counted = {r["b"]: r["n"] for r in clipped.filter("_z IS NOT NULL").groupBy(F.least(F.floor((F.col("_z") + 10) * bins / 20), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n")).collect()}  # at most `bins` rows
    count = np.array([counted.get(i, 0) for i in range(bins)], float)
    mid = -10 + (np.arange(bins) + 0.5) * 20 / bins
    x = np.polynomial.legendre.legvander(mid / 10, degree)
    w = np.zeros(degree + 1)
    w[0] = np.log(max(count.mean(), 1e-3))
    for _ in range(100):
        mu = np.exp(np.clip(x @ w, -30, 30))
        step = np.linalg.solve((x * mu[:, None]).T @ x + 1e-6 * np.eye(degree + 1), x.T @ (count - mu) - 1e-6 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    density = np.exp(np.clip(x @ w, -30, 30))
    total = max(count.sum(), 1)
    cum = np.cumsum(count) / total
    lo, med, hi = (float(np.interp(v, cum, mid)) for v in (0.25, 0.5, 0.75))
    sd = max((hi - lo) / 1.349, 1e-3)
    null = special.norm_pdf(mid, med, sd) * total * 20 / bins
    at0 = np.abs(mid - med) <= sd
    share = min(1.0, float((count[at0].sum() + 1e-9) / max(null[at0].sum(), 1e-9)))
    fdr = np.minimum(1.0, share * null / np.maximum(density, 1e-12))
    table = F.array(*[F.lit(float(v)) for v in fdr])
    return clipped.withColumn("locfdr", F.get(table, F.least(F.floor((F.col("_z") + 10) * bins / 20), F.lit(bins - 1)).cast("int"))).drop("_z")


def dose_points(points: DataFrame, orf: str) -> DataFrame:
    """(sgrna, slope, n): each guide's slope of log10 abundance on log2 dose."""
    least = points.filter("dose > 0").agg(F.min("dose").alias("d")).first()["d"] or 1.0
    p = points.filter(F.col("orf") == orf).select("sgrna", F.log2(F.when(F.col("dose") == 0, least / 2).otherwise(F.col("dose"))).alias("x"), F.log10(F.greatest("abundance", F.lit(1e-8))).alias("y"))
    return p.groupBy("sgrna").agg(F.expr("regr_slope(y, x)").alias("slope"), F.count("*").alias("n"))
