"""Genetic interactions between two strains and two conditions, by truncated-normal posteriors per gene."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions import special
from lociq.operators.joins import dealt, with_metadata
from lociq.operators.windows import bfdr, fwer_bayes, trimmed_mean


def truncated_posterior(n: float, mean: float, var: float, mu0: float, s20: float, size: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of the mean, at least 0, under a normal with unknown mean and variance (k0 = nu0 = 1).

    A draw below 0 is made anew under its own variance, which leaves the truncated law; what is left after some rounds takes quantiles of it.
    """
    kn, nun = 1 + n, 1 + n
    mun = (mu0 + n * mean) / kn
    s2n = max((s20 + max(n - 1, 0) * var + n / kn * (mean - mu0) ** 2) / nun, 1e-12)
    s2 = 1 / rng.gamma(nun / 2, 2 / (s2n * nun), size)
    sd = np.sqrt(s2 / kn)
    found = mun + sd * rng.standard_normal(size)
    left = np.flatnonzero(found < 0)
    for _ in range(8):
        if not len(left):
            return found
        found[left] = mun + sd[left] * rng.standard_normal(len(left))
        left = left[found[left] < 0]
    low = special.norm_sf(mun / sd[left])  # mass below 0
    found[left] = np.maximum(mun + sd[left] * special.norm_ppf(np.clip(low + rng.random(len(left)) * (1 - low), 1e-15, 1 - 1e-15)), 0)
    return found


def hdi(draws: np.ndarray, mass: float = 0.95) -> tuple[float, float]:
    """The shortest window of ceil(mass * S) order statistics."""
    x = np.sort(draws)
    n = int(np.ceil(mass * len(x)))
    width = x[n - 1 :] - x[: len(x) - n + 1]
    i = int(width.argmin())
    return float(x[i]), float(x[i + n - 1])


def genetic_interactions(site_gene: DataFrame, groups: DataFrame | None, samples: int = 10_000, rope: float = 0.5, signif: str = "HDI", seed: int = 0, pseudo: float = 1e-6) -> DataFrame:
    """(orf, n_sites, a1, a2, b1, b2, lfc_a, lfc_b, delta, lower, upper, outside, prob_rope, adjusted, type).

    groups is (sample_id, cell) with cells A1, A2 (strain A in conditions 1 and 2), B1 and B2. Priors come from 1 % trimmed means over genes.
    Without groups, site_gene is (orf, cell, n, m, v, sites) of interactions_of_cells() already.
    """
    if groups is None:
        return interactions_of_cells(site_gene, samples, rope, signif, seed, pseudo)
    each = with_metadata(site_gene, groups).groupBy("orf", "cell").agg(F.count("*").alias("n"), F.avg("count").alias("m"), F.var_pop("count").alias("v"), F.countDistinct("position").alias("sites"))
    return interactions_of_cells(each, samples, rope, signif, seed, pseudo)


def interactions_of_cells(each: DataFrame, samples: int = 10_000, rope: float = 0.5, signif: str = "HDI", seed: int = 0, pseudo: float = 1e-6) -> DataFrame:
    """genetic_interactions() from (orf, cell, n, m, v, sites): number, mean and variance of a gene's counts in a cell, and its sites."""
    many = each.filter("n > 1")
    prior_m = trimmed_mean(many, ["cell"], "m", 0.01).withColumnRenamed("trimmed_mean", "mu0")
    prior_v = trimmed_mean(many, ["cell"], "v", 0.01).withColumnRenamed("trimmed_mean", "s20")
    rows = each.join(F.broadcast(prior_m.join(prior_v, "cell")), "cell")  # four rows
    wide = rows.groupBy("orf").pivot("cell", ["A1", "A2", "B1", "B2"]).agg(*[F.first(c).alias(c) for c in ("n", "m", "v", "mu0", "s20", "sites")]).na.drop()

    def kernel(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                rng = np.random.default_rng([seed, *r["orf"].encode()])
                d = {c: truncated_posterior(r[f"{c}_n"], r[f"{c}_m"], r[f"{c}_v"] * r[f"{c}_n"] / max(r[f"{c}_n"] - 1, 1), r[f"{c}_mu0"], r[f"{c}_s20"], samples, rng) for c in ("A1", "A2", "B1", "B2")}
                a, b = np.log2((d["A2"] + pseudo) / (d["A1"] + pseudo)), np.log2((d["B2"] + pseudo) / (d["B1"] + pseudo))
                delta = b - a
                lo, hi = hdi(delta)
                out.append((r["orf"], r["A1_sites"], *(float(d[c].mean()) for c in ("A1", "A2", "B1", "B2")), float(a.mean()), float(b.mean()), float(delta.mean()), lo, hi, bool(hi < -rope or lo > rope), float((np.abs(delta) <= rope).mean())))
            yield pd.DataFrame(out, columns=["orf", "n_sites", "a1", "a2", "b1", "b2", "lfc_a", "lfc_b", "delta", "lower", "upper", "outside", "prob_rope"])

    # By a hash: rows that lie by gene already would not be dealt anew.
    found = dealt(wide, F.xxhash64("orf")).mapInPandas(kernel, "orf string, n_sites long, a1 double, a2 double, b1 double, b2 double, lfc_a double, lfc_b double, delta double, lower double, upper double, outside boolean, prob_rope double")
    if signif == "BFDR":
        found = bfdr(found, "prob_rope").withColumnRenamed("bfdr", "adjusted").withColumn("outside", F.col("adjusted") < 0.05)
    elif signif == "FWER":
        found = fwer_bayes(found, "prob_rope").withColumnRenamed("fwer", "adjusted").withColumn("outside", F.col("adjusted") < 0.05)
    else:
        found = found.withColumn("adjusted", F.col("prob_rope"))
    kind = F.when(~F.col("outside"), "No Interaction").when(F.col("delta") < 0, "Aggravating").when((F.col("delta") > 0) & (F.abs("lfc_b") < F.abs("lfc_a")), "Suppressive").otherwise("Alleviating")
    return found.withColumn("type", kind)
