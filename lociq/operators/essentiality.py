"""Essentiality calls from runs of empty sites and from hidden Markov models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions import special
from lociq.operators.aggregates import regress
from lociq.operators.joins import beside_each, dealt, overlap_columns, overlaps, small, with_metadata
from lociq.operators.ordered import in_order, placed, running, tidy
from lociq.operators.windows import bh_fdr, essentiality_thresholds
from lociq.scratch import keep

EULER = 0.5772156649015329


SHORT = 20  # below so many sites the expected longest run is exact


def short_runs(p: float) -> np.ndarray:
    """Expected longest runs of non-insertions over 0 to SHORT - 1 sites with insertion probability p."""
    q, k = 1 - p, np.arange(SHORT)
    # at_most[i][k]: probability that the longest run of i sites has at most k; the recursion removes the runs that end at site i.
    at_most = np.ones((SHORT, SHORT))
    for i in range(1, SHORT):
        ended = np.where(k < i - 1, at_most[np.maximum(i - k - 2, 0), k], 1.0) * p * q ** (k + 1)
        at_most[i] = np.where(k >= i, 1.0, np.where(k == i - 1, 1 - q**i, at_most[i - 1] - ended))
    return (1 - at_most).sum(1)  # the sum over k of P(longest > k)


def expected_run(n: int, p: float) -> float:
    """Expected longest run of non-insertions over n sites with insertion probability p."""
    q = 1 - p
    if n == 0 or q <= 0:
        return 0.0
    if n < SHORT:
        return float(short_runs(p)[n])
    return float(np.log(n * p) / np.log(1 / q) + EULER / np.log(1 / q) - 0.5 + 0.000016 + 0.01)


def variance_run(q: float) -> float:
    """Variance of the longest run with non-insertion probability q."""
    return float(np.pi**2 / (6 * np.log(1 / q) ** 2) + 1 / 12 + 0.00006 + 0.01)


def griffin(blocks: DataFrame, theta: float | None) -> DataFrame:
    """(orf, k, n, max_run, expected_run, pval): Gumbel tail of the longest run; exact expectations below 20 sites from a table of 20 values.

    theta is the share of hit sites. Where all sites are hit the expected run is 0, where none is (or there are no sites) it is the
    whole gene; a run as expected has p = 1, and there is no other then.
    """
    if not theta or theta >= 1:
        sure = F.lit(0.0) if theta else F.col("n").cast("double")
        return blocks.withColumn("expected_run", sure).withColumn("pval", F.lit(1.0)).select("orf", "k", "n", "max_run", "expected_run", "pval")
    table = F.array(*[F.lit(float(x)) for x in short_runs(theta)])
    beta = float(1 / np.log(1 / (1 - theta)))
    closed = F.log(F.col("n") * theta) * beta + EULER * beta - 0.5 + 0.000016 + 0.01
    out = blocks.withColumn("expected_run", F.when(F.col("n") < SHORT, F.get(table, F.col("n").cast("int"))).otherwise(closed))
    u = F.col("expected_run") - EULER * beta
    return out.withColumn("pval", F.when(F.col("n") > 0, 1 - F.exp(-F.exp((u - F.col("max_run")) / beta))).otherwise(1.0)).select("orf", "k", "n", "max_run", "expected_run", "pval")


def insertion_rates(track: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_sites, p_insertion) of counts: a row a sample."""
    return track.groupBy(*keys).agg(F.count("*").alias("n_sites"), F.avg((F.col("count") > 0).cast("double")).alias("p_insertion"))


def gaps(runs: DataFrame, genes: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Each sample's genes with the run that overlaps them most: (keys, orf, run_id, run_length, overlap, pval, padj, call). First run wins ties.

    runs has the samples' keys, and rates a row a sample (insertion_rates). A sample without any hit, or with all sites hit, says nothing
    about its runs: p = 1. Corrected within each sample.
    """
    p = F.col("p_insertion")
    rates = small(rates)
    beta = 1 / F.log(1 / (1 - p))
    tail = 1 - F.exp(-F.exp((F.log(F.col("n_sites") * p) * beta - F.col("length")) / beta))
    met = overlap_columns(overlaps(runs, genes)).join(rates, keys).withColumn("pval", F.when((p > 0) & (p < 1), tail).otherwise(1.0))
    best = met.groupBy(*keys, "orf").agg(F.max(F.struct("overlap", (-F.col("run_id")).alias("_r"), "length", "pval")).alias("b"))
    out = beside_each(genes.select("orf"), rates.select(*keys)).join(best, [*keys, "orf"], "left")
    out = out.select(*keys, "orf", (-F.col("b._r")).alias("run_id"), F.coalesce("b.length", F.lit(0)).alias("run_length"), F.coalesce("b.overlap", F.lit(0)).alias("overlap"), F.coalesce("b.pval", F.lit(1.0)).alias("pval"))
    return bh_fdr(out, keys=keys).withColumn("call", F.when(F.col("padj") < 0.05, "Essential").otherwise("Non-essential"))


def gumbel_chain(rows: pd.DataFrame, phi: float, mu_s: float, mu_r: float, sigma_s: float, sigma_r: float, samples: int, burnin: int, trim: int, seed: int, step: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances, [half, row], of the essential probability of each row (n, r, s, t, m) over both halves of a Metropolis-within-Gibbs chain.

    A row stands for m genes with the same figures: how many of them are essential is drawn as one binomial. A longer chain with the
    same seed begins with the shorter one.
    """
    rng = np.random.default_rng(seed)
    n, r, s, t, m = (rows[c].to_numpy(float) for c in ("n", "r", "s", "t", "m"))
    genes, short = m.astype(np.int64), np.flatnonzero(n < SHORT)

    def log_gumbel(p: float) -> np.ndarray:
        beta = 1 / np.log(1 / p)
        mu = np.log(np.maximum(n * (1 - p), 1e-12)) * beta
        mu[short] = short_runs(1 - p)[n[short].astype(int)] - EULER * beta
        z = (r - mu) / beta
        return -z - np.exp(np.clip(-z, -700, 700)) - np.log(beta)

    steps = np.arange(1, int(t.max()) + 1)
    sums = np.concatenate([[1e-300], np.cumsum(1 / (1 + np.exp(-np.clip(0.1 * (steps - 300), -500, 500))))])
    sig = 1 / (1 + np.exp(-np.clip(0.1 * (s - 300), -500, 500))) / sums[t.astype(int)]
    essential = sig * special.norm_pdf(r, mu_r * s, sigma_r)
    spread = special.norm_pdf(s, mu_s * r, sigma_s)
    w1, z = 0.15, rng.binomial(genes, 0.5)
    total, square, kept = np.zeros((2, len(n))), np.zeros((2, len(n))), np.zeros(2)
    now = log_gumbel(phi)
    for i in range(samples * trim + burnin):
        new = phi + rng.normal(0, step)
        if 0.01 < new < 0.99:
            other = log_gumbel(new)
            if np.log(rng.random()) < ((m - z) * (other - now)).sum():
                phi, now = new, other
        h0 = np.exp(now) * spread * (1 - w1) + 1e-10
        h1 = essential * w1 + 1e-10
        share = h1 / (h0 + h1)
        z = rng.binomial(genes, share)
        w1 = rng.beta(600 + z.sum(), 3400 + m.sum() - z.sum())
        if i >= burnin and (i - burnin) % trim == 0:
            half = int(i - burnin >= samples * trim // 2)
            total[half] += share
            square[half] += share * share
            kept[half] += 1
    mean = total / np.maximum(kept, 1)[:, None]
    return mean, np.maximum(square / np.maximum(kept, 1)[:, None] - mean * mean, 0)


def variance_ratio(half: int) -> Column:
    """The split-chain ratio over rows (mean, v) of half chains of `half` samples: the root of the pooled variance over that within; 1 where nothing varies."""
    within, between = F.avg("v"), F.coalesce(F.var_samp("mean"), F.lit(0.0))
    pooled = within * (half - 1) / half + between
    return F.when(pooled < 1e-12, 1.0).otherwise(F.sqrt(pooled / F.greatest(within, F.lit(1e-15))))


def gumbel(blocks: DataFrame, samples: int = 1000, burnin: int = 100, trim: int = 1, chains: int = 4, seed: int = 0, limit: float | None = 1.1, rounds: int = 3, step: float = 0.01, spread: float = 0.03) -> DataFrame:
    """(orf, k, n, max_run, gap_span, zbar, ratio, call): E, EB, U, NE or S from blocks (orf, n, k, max_run, gap_span, span, theta).

    Chains start `spread` apart in the share of empty sites.

    Genes with n >= 3 and a span of 150 are analysed; chains run in parallel over the distinct (n, r, s, t) and are averaged. ratio is the
    split-chain variance ratio of a gene's probability. While the largest one is above `limit`, all chains go on to twice their samples
    (the same seeds give the same beginning); after `rounds` doublings that is an error. limit None: one round, only reported.
    """
    used = blocks.filter("n >= 3 AND span >= 150")
    total = used.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    phi = 1 - (total["k"] or 0) / max(total["n"] or 1, 1)
    fit = [regress(used, a, b).first() for a, b in (("max_run", "gap_span"), ("gap_span", "max_run"))]
    mu_s, mu_r = (f["slope"] or 1.0 for f in fit)
    sigma_s, sigma_r = (max(f["residual_sd"] or 1.0, 1e-3) for f in fit)
    distinct = keep(used.groupBy(F.col("n"), F.col("max_run").alias("r"), F.col("gap_span").alias("s"), F.col("span").alias("t")).agg(F.count("*").alias("m")), "figures")

    def chained(length: int) -> DataFrame:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["n", "r", "s", "t"])
            chain = int(rows["chain"].iloc[0])
            start = phi + spread * (chain - (chains + 1) / 2)  # chains from different places, or their agreement would say little
            mean, v = gumbel_chain(rows, float(min(max(start, 0.02), 0.98)), mu_s, mu_r, sigma_s, sigma_r, length, burnin, trim, seed + chain, step)
            return pd.concat([rows[["n", "r", "s", "t"]].assign(mean=mean[h], v=v[h]) for h in (0, 1)])

        dealt = distinct.withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(chains)))).groupBy("chain")
        halves = dealt.applyInPandas(run, "n long, r long, s long, t long, mean double, v double")
        return keep(halves.groupBy("n", "r", "s", "t").agg(F.avg("mean").alias("zbar"), variance_ratio(max(length // 2, 1)).alias("ratio")), "chains")

    zbar = chained(samples)
    for k in range(1, rounds + 1 if limit else 1):
        worst = zbar.agg(F.max("ratio")).first()[0]
        if worst is None or worst <= limit:
            break
        zbar = chained(samples << k)
        if k == rounds and zbar.agg(F.max("ratio")).first()[0] > limit:
            raise RuntimeError(f"the chains do not agree after {samples << k} samples: the variance ratio is {worst:.3f}, above {limit}")
    out = blocks.join(zbar, (blocks["n"] == zbar["n"]) & (blocks["max_run"] == zbar["r"]) & (blocks["gap_span"] == zbar["s"]) & (blocks["span"] == zbar["t"]), "left").drop(zbar["n"]).drop("r", "s", "t")
    out = keep(out.withColumn("zbar", F.when((F.col("n") >= 3) & (F.col("span") >= 150), F.coalesce("zbar", F.lit(-1.0))).otherwise(-1.0)), "posteriors")
    cut = essentiality_thresholds(out.filter("zbar >= 0"), "zbar").withColumn("_k", F.lit(1))
    out = out.withColumn("_k", F.lit(1)).join(F.broadcast(cut), "_k").drop("_k")  # one row
    long_enough = F.col("n") > float(np.log10(0.05) / np.log10(min(max(phi, 0.02), 0.98)))
    call = F.when(F.col("zbar") < 0, "S").when(F.col("zbar") > F.col("upper"), "E").when((F.col("theta") == 0) & long_enough, "EB").when(F.col("zbar") > F.col("lower"), "U").otherwise("NE")
    return out.withColumn("call", call).select("orf", "k", "n", "max_run", "gap_span", "zbar", "ratio", "call")


STATES = ("ES", "GD", "NE", "GA")


def hmm_parameters(track: DataFrame) -> DataFrame:
    """(condition, m, pins) of combined counts (condition, contig, position, count): the mean of the lowest 95 % of
    non-zero counts, and the hit share without runs of 10 or more zeros and the trailing zeros. Without hits m is 1 and pins 0."""
    hits = track.filter("count > 0").groupBy("condition", "count").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("condition").orderBy("count").rowsBetween(Window.unboundedPreceding, 0)  # a row a distinct count
    cut = F.floor(F.sum("c").over(Window.partitionBy("condition")) * 0.95)
    used = F.greatest(F.least(F.sum("c").over(upto), cut) - (F.sum("c").over(upto) - F.col("c")), F.lit(0))
    means = hits.withColumn("_u", used).groupBy("condition").agg((F.sum(F.col("count") * F.col("_u")) / F.nullif(F.sum("_u"), F.lit(0))).alias("m"), F.max("count").alias("top"))
    keys = ["condition", "contig"]
    laid = running(in_order(track.select(*keys, "position", "count"), keys, ["position"], "track"), keys, {"_i": (F.col("count") > 0).cast("int")})
    island = laid.groupBy(*keys, "_i").agg(F.count_if(F.col("count") == 0).alias("z"))
    last = island.groupBy(*keys).agg(F.max("_i").alias("_last"))
    kept = island.join(last, keys).withColumn("z", F.when((F.col("z") >= 10) | (F.col("_i") == F.col("_last")), 0).otherwise(F.col("z")))
    hit = F.count_if(F.col("_i") > 0)
    pins = kept.groupBy("condition").agg(F.coalesce(hit / F.nullif(hit + F.sum("z"), F.lit(0)), F.lit(0.0)).alias("pins"))
    return pins.join(means, "condition", "left").select("condition", F.coalesce("m", "top", F.lit(1.0)).alias("m"), "pins")


def hmm_model(m: float, pins: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission parameters, log transitions and log start of the four states. No parameter is above that of the empty state, 0.99,
    so that a mean of 1 is defined; a condition without hits is in that state throughout."""
    p = np.minimum(1 / np.array([1 / 0.99, 0.01 * m + 2, m, 5 * m]), 0.99)
    r = 1
    while (1 - pins) ** r >= 0.01 and r < 10_000:
        r += 1
    change = r * np.log(p[2])
    a = np.full((4, 4), change + np.log(1 / 3))
    np.fill_diagonal(a, np.log1p(-np.exp(change)))
    return p, a, np.log([0.7, 0.1, 0.1, 0.1])


def _emissions(count: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log P(count + 1) of each state's geometric."""
    values, at = np.unique(count, return_inverse=True)
    return (values[:, None] * np.log1p(-p) + np.log(p))[at]


def _segmented(log_e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sites cut into about as many segments as a segment has sites, [segment, place, state], and which places hold a site."""
    n = len(log_e)
    length = max(1, int(np.ceil(np.sqrt(n))))
    count = -(-n // length)
    padded = np.zeros((count * length, 4))
    padded[:n] = log_e
    return padded.reshape(count, length, 4), (np.arange(count * length) < n).reshape(count, length)


def _segment_transfers(cells: np.ndarray, real: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-product transfers of all segments (scaled, and the logs of their scales) and max-plus ones; all segments advance together."""
    move, count = np.exp(a), len(cells)
    total, scale = np.tile(np.eye(4), (count, 1, 1)), np.zeros(count)
    best = np.tile(np.where(np.eye(4) > 0, 0.0, -np.inf), (count, 1, 1))
    for i in range(cells.shape[1]):
        e, ok = cells[:, i][:, None, :], real[:, i][:, None, None]
        total = np.where(ok, (total @ move) * np.exp(e), total)
        best = np.where(ok, (best[:, :, :, None] + a).max(2) + e, best)
        top = total.max((1, 2))
        total /= top[:, None, None]
        scale += np.log(top)
    return total, scale, best


def block_transfer(log_e: np.ndarray, a: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product and max-plus 4x4 transfers of a block, in logs; with start, the first site has no transition."""
    total, scale, best = np.eye(4), 0.0, np.where(np.eye(4) > 0, 0.0, -np.inf)
    if start is not None:
        total, best = np.tile(np.exp(start + log_e[0]), (4, 1)), np.tile(start + log_e[0], (4, 1))
        log_e = log_e[1:]
    if len(log_e):
        for t, c, b in zip(*_segment_transfers(*_segmented(log_e), a)):
            total, best = total @ t, (best[:, :, None] + b).max(1)
            top = total.max()
            total, scale = total / top, scale + c + np.log(top)
    with np.errstate(divide="ignore"):
        return np.log(total) + scale, best


def block_states(log_e: np.ndarray, a: np.ndarray, start: np.ndarray | None, alpha: np.ndarray, delta: np.ndarray, beta: np.ndarray, exit_state: int) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi states and posteriors of a block, from what stands before it and after it.

    Segment transfers give each segment what stands at its ends; then all segments are filled in together.
    """
    n, move = len(log_e), np.exp(a)
    f, head = np.exp(alpha - alpha.max()), 0
    if start is not None:
        f, delta, head = np.exp(start + log_e[0]), start + log_e[0], 1
    f = f / f.sum()
    fwd, bwd, back = np.empty((n, 4)), np.empty((n, 4)), np.zeros((n, 4), int)
    b = np.exp(beta - beta.max())
    if n > head:
        cells, real = _segmented(log_e[head:])
        total, _, best = _segment_transfers(cells, real, a)
        count, length = real.shape
        into, reach, behind = np.empty((count, 4)), np.empty((count, 4)), np.empty((count, 4))
        g, d = f, delta
        for s in range(count):
            into[s], reach[s] = g, d
            g, d = g @ total[s], (d[:, None] + best[s]).max(0)
            g = g / g.sum()
        for s in range(count - 1, -1, -1):
            behind[s] = b
            b = total[s] @ b
            b = b / b.sum()
        forward, backward, came = np.empty((count, length, 4)), np.empty((count, length, 4)), np.zeros((count, length, 4), int)
        for i in range(length):
            e = cells[:, i]
            into = (into @ move) * np.exp(e)
            into /= into.sum(1, keepdims=True)
            score = reach[:, :, None] + a
            came[:, i], reach = score.argmax(1), score.max(1) + e
            forward[:, i] = into
        for i in range(length - 1, -1, -1):
            backward[:, i] = behind
            before = (np.exp(cells[:, i]) * behind) @ move.T
            behind = np.where(real[:, i][:, None], before / before.sum(1, keepdims=True), behind)
        for whole, parts in ((fwd, forward), (bwd, backward), (back, came)):
            whole[head:] = parts.reshape(-1, 4)[: n - head]
    if head:
        fwd[0], bwd[0] = f, b
    post = fwd * bwd
    states, path = [exit_state], back.tolist()
    for i in range(n - 1, 0, -1):
        states.append(path[i][states[-1]])
    return np.array(states[::-1]), post / post.sum(1, keepdims=True)


def hmm(track: DataFrame, block: int = 10_000) -> DataFrame:
    """Each site's state and posteriors: (condition, contig, position, count, state, es, gd, ne, ga).

    Blocks of sites give their 4x4 transfers in parallel; a short pass over the blocks of a contig carries them
    along; each block is then filled in by itself. The result is that of one pass over the contig.
    """
    keys = ["condition", "contig"]
    laid = placed(in_order(track.select(*keys, "position", "count"), keys, ["position"], "track"), keys)
    numbered = tidy(laid.withColumn("block", F.expr(f"(_n - 1) div {block}L")).drop("_n"))
    cut = keep(with_metadata(numbered, hmm_parameters(track), "condition"), "blocks")  # a row a condition

    def transfer(rows: pd.DataFrame) -> pd.DataFrame:
        p, a, start = hmm_model(rows["m"].iloc[0], rows["pins"].iloc[0])
        first = rows["block"].iloc[0] == 0
        total, best = block_transfer(_emissions(rows.sort_values("position")["count"].to_numpy(float), p), a, start if first else None)
        return pd.DataFrame({"condition": [rows["condition"].iloc[0]], "contig": [rows["contig"].iloc[0]], "block": [rows["block"].iloc[0]], "total": [total.ravel().tolist()], "best": [best.ravel().tolist()]})

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block").reset_index(drop=True)
        total = np.array(rows["total"].tolist()).reshape(-1, 4, 4)
        best = np.array(rows["best"].tolist()).reshape(-1, 4, 4)
        n = len(rows)
        alpha, delta, beta, leave = np.zeros((n + 1, 4)), np.zeros((n + 1, 4)), np.zeros((n + 1, 4)), np.zeros(n, int)
        for i in range(n):
            if i == 0:  # the rows of a first block's transfer are equal: its start is inside
                alpha[1], delta[1] = total[0][0], best[0][0]
            else:
                alpha[i + 1] = np.logaddexp.reduce(alpha[i][:, None] + total[i], axis=0)
                delta[i + 1] = (delta[i][:, None] + best[i]).max(0)
        for i in range(n - 1, 0, -1):
            beta[i] = np.logaddexp.reduce(total[i] + beta[i + 1][None, :], axis=1)
        leave[-1] = delta[n].argmax()
        for i in range(n - 1, 0, -1):
            leave[i - 1] = (delta[i] + best[i][:, leave[i]]).argmax()
        return pd.DataFrame({"condition": rows["condition"], "contig": rows["contig"], "block": rows["block"], "alpha": alpha[:-1].tolist(), "delta": delta[:-1].tolist(), "beta": beta[1:].tolist(), "leave": leave})

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position").reset_index(drop=True)
        p, a, start = hmm_model(rows["m"].iloc[0], rows["pins"].iloc[0])
        one = rows.iloc[0]
        states, post = block_states(_emissions(rows["count"].to_numpy(float), p), a, start if one["block"] == 0 else None, np.array(one["alpha"]), np.array(one["delta"]), np.array(one["beta"]), int(one["leave"]))
        out = rows[["condition", "contig", "position", "count"]].copy()
        out["state"] = np.array(STATES)[states]
        for i, name in enumerate(("es", "gd", "ne", "ga")):
            out[name] = post[:, i]
        return out

    each = ["condition", "contig", "block"]
    transfers = dealt(cut, *each).groupBy(*each).applyInPandas(transfer, "condition string, contig string, block long, total array<double>, best array<double>")
    carried = transfers.groupBy("condition", "contig").applyInPandas(carry, "condition string, contig string, block long, alpha array<double>, delta array<double>, beta array<double>, leave int")
    return dealt(cut, *each).join(carried, each).groupBy(*each).applyInPandas(fill, "condition string, contig string, position long, count double, state string, es double, gd double, ne double, ga double")


def hmm_genes(sites: DataFrame, genes: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """([groups' columns,] orf, n, es, gd, ne, ga, saturation, nz_mean, call) from sites (orf, state, count): ES if all sites are, else the most frequent state, later ones on ties.

    groups (a row a sample or condition, its columns also in sites): every gene for each of them.
    """
    keys = groups.columns if groups is not None else []
    counted = {s.lower(): F.count_if(F.col("state") == s) for s in STATES}
    each = sites.groupBy(*keys, "orf").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in counted.items()], F.avg((F.col("count") > 0).cast("double")).alias("saturation"), F.coalesce(F.avg(F.when(F.col("count") > 0, F.col("count"))), F.lit(0.0)).alias("nz_mean"))
    every = beside_each(genes.select("orf"), groups) if keys else genes.select("orf")
    return hmm_calls(every.join(each, [*keys, "orf"], "left").fillna(0, ["n", "es", "gd", "ne", "ga", "saturation", "nz_mean"]))


def hmm_calls(out: DataFrame) -> DataFrame:
    """Genes (n, es, gd, ne, ga, …) with their call: N/A without sites."""
    most = F.greatest(*[F.struct(F.col(s.lower()).alias("c"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(STATES)])["s"]
    return out.withColumn("call", F.when(F.col("n") == 0, "N/A").when(F.col("es") == F.col("n"), "ES").otherwise(most))


def hmm_confidence(genes: DataFrame, factor: float = 0.7314, keys: list[str] | None = None) -> DataFrame:
    """Genes with consistency, the four states' probabilities, confidence and flag, from normal densities of saturation * nz_mean around each call's median.

    keys: each sample or condition by itself.
    """
    keys = keys or []
    own = keep(genes.filter("n > 0").withColumn("value", F.col("saturation") * F.col("nz_mean")), "calls")
    quarters = F.percentile("value", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)]))
    spread = own.groupBy(*keys, "call").agg(quarters.alias("_q")).select(*keys, "call", F.element_at("_q", 2).alias("mid"), F.greatest(factor * (F.element_at("_q", 3) - F.element_at("_q", 1)), F.lit(1.0)).alias("sd"))
    centres = spread.groupBy(*[F.col(k) for k in keys], F.lit(0).alias("_one")).agg(F.map_from_entries(F.collect_list(F.struct("call", F.struct("mid", "sd")))).alias("_c"))  # at most four entries
    out = with_metadata(own.withColumn("_one", F.lit(0)), centres, [*keys, "_one"]).drop("_one")

    def density(s: str) -> Column:
        mid, sd = F.col("_c")[s]["mid"], F.col("_c")[s]["sd"]
        return F.coalesce(F.exp(-0.5 * F.pow((F.col("value") - mid) / sd, 2)) / (sd * float(np.sqrt(2 * np.pi))), F.lit(0.0))

    out = out.withColumns({f"p_{s.lower()}": density(s) for s in STATES}).drop("_c")
    total = F.nullif(sum((F.col(f"p_{s.lower()}") for s in STATES), F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("_t", total).withColumns({f"p_{s.lower()}": F.coalesce(F.col(f"p_{s.lower()}") / F.col("_t"), F.lit(0.0)) for s in STATES})
    pick = lambda prefix: F.coalesce(*[F.when(F.col("call") == s, F.col(prefix + s.lower())) for s in STATES])
    best = F.greatest(*[F.col(f"p_{s.lower()}") for s in STATES])
    out = out.withColumn("consistency", pick("") / F.col("n")).withColumn("confidence", pick("p_"))
    return out.withColumn("flag", F.when(F.col("confidence") < 0.2, "low-confidence").when(F.col("confidence") < best, "ambiguous").otherwise("")).drop("_t")
