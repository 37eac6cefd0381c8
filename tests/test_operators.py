"""Hand-computed vectors, brute force and invariants for the operators that SQL cannot check."""

import itertools
import math
import time
from collections import Counter

import numpy as np
import pandas as pd
from lociq.operators import aggregates, crispri, essentiality, genesets, interactions, joins, normalise, reads, tests, ttn, windows
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def blocks_of(spark, seed=0, genes=30, sites=25, lift=0.0):
    """Counts of 3 + 3 samples over genes; the first five are lifted in the second condition."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(genes):
        for s in range(sites):
            for k in range(6):
                hit = rng.random() < 0.6
                rows.append((f"g{g}", g * 1000 + s, f"s{k}", float(hit * rng.geometric(1 / (30 * (1 + lift * (k >= 3 and g < 5)))))))
    sg = frame(spark, rows, "orf string, position long, sample_id string, count double")
    samples = frame(spark, [(f"s{k}", "ctrl" if k < 3 else "exp", k) for k in range(6)], "sample_id string, condition string, k int")
    return sg, samples, sg.select("orf").distinct()


def test_bh(spark):
    p = [0.01, 0.02, 0.02, 0.5, None, float("nan"), 1.0]
    got = {r.orf: r.padj for r in windows.bh_fdr(frame(spark, [(str(i), x) for i, x in enumerate(p)], "orf string, pval double")).collect()}
    want = {"0": 0.05 * 1, "1": 0.02 * 5 / 3, "2": 0.02 * 5 / 3, "3": 0.5 * 5 / 4, "6": 1.0}
    want["0"] = min(0.05, want["1"])
    assert all(math.isclose(got[k], v) for k, v in want.items()) and got["4"] is None and got["5"] is None


def test_gene_example(spark):
    reads_ = [0, 0, 0, 0, 1, 3, 0, 1]
    sg = frame(spark, [("g", 10 * i, "s", float(x)) for i, x in enumerate(reads_)], "orf string, position long, sample_id string, count double")
    r = aggregates.gene_block_stats(sg, frame(spark, [("g",), ("none",)], "orf string")).collect()
    got = {x.orf: x for x in r}
    assert (got["g"].k, got["g"].n, got["g"].max_run, got["g"].theta, got["g"].phi, got["g"].gap_span) == (3, 8, 4, 0.375, 0.625, 32)
    assert got["none"].n == 0 and got["none"].theta == 0


def test_interval_joins_against_loops(spark):
    rng = np.random.default_rng(1)
    genes = [("c1", f"g{i}", int(s), int(s + rng.integers(5, 900)), "+-"[i % 2]) for i, s in enumerate(rng.integers(1, 3000, 40))]
    sites = [("c1", int(p)) for p in np.unique(rng.integers(1, 4000, 300))]
    g = frame(spark, genes, "contig string, orf string, start long, end long, strand string")
    s = frame(spark, sites, "contig string, position long")
    for variant in "AB":
        want = set()
        for _, orf, a, b, strand in genes:
            x, y = (a, b) if variant == "A" else (a if strand == "+" else a + 3, b - 3 if strand == "+" else b)
            for _, p in sites:
                codon = True if variant == "B" else (p <= b - 3 if strand == "+" else p >= a + 3)
                if x <= p <= y and codon and y > x and 0.05 <= (p - x) / (y - x) <= 0.9:
                    want.add((p, orf))
        got = {(r.position, r.orf) for r in joins.assign_sites(s, g, 5, 10, True, variant).collect()}
        assert got == want


def test_runs_cover_all_empty_sites(spark):
    counts = [0, 0, 3, 0, 5, 5, 0, 0, 0]
    df = frame(spark, [("a", i, float(c)) for i, c in enumerate(counts)], "sample_id string, position long, count double")
    got = sorted((r.start_idx, r.end_idx, r.length) for r in windows.runs(df, ["sample_id"]).collect())
    assert got == [(1, 2, 2), (4, 4, 1), (7, 9, 3)]


def test_anova_and_null_calibration(spark):
    sg, samples, genes = blocks_of(spark, lift=3.0)
    got = {r.orf: r for r in tests.anova(sg, samples, genes, alpha=10.0).collect()}
    pdf = sg.toPandas().merge(samples.toPandas(), on="sample_id")
    for orf in ("g0", "g9"):
        x = [v["count"].to_numpy() for _, v in pdf[pdf.orf == orf].groupby("condition")]
        m = np.concatenate(x).mean()
        msr = sum(len(v) * (v.mean() - m) ** 2 for v in x) / (len(x) - 1)
        mse = sum(((v - v.mean()) ** 2).sum() for v in x) / (sum(map(len, x)) - len(x)) + 10
        assert math.isclose(got[orf].fstat, msr / mse, rel_tol=1e-9)
    assert sum(got[f"g{i}"].padj < 0.05 for i in range(5)) >= 4
    quiet = tests.anova(*blocks_of(spark, seed=4), alpha=10.0).collect()
    assert sum(r.padj < 0.05 for r in quiet) <= 1


def test_exact_u():
    a, b = [1.0, 4.0, 9.0], [2.0, 3.0, 7.0, 11.0]
    pool = a + b

    def u(first):
        rest = [x for x in pool if x not in first]
        return sum(x > y for x in first for y in rest)

    seen = [u(c) for c in itertools.combinations(pool, 3)]
    observed = u(a)
    low = min(observed, 12 - observed)
    assert math.isclose(tests._exact_u(3, 4, observed), min(1, 2 * np.mean([x <= low for x in seen])))
    for n1, n2 in ((1, 6), (2, 5), (4, 4), (5, 2)):
        seen = [sum(x > y for x in c for y in set(range(n1 + n2)) - set(c)) for c in itertools.combinations(range(n1 + n2), n1)]
        for at in range(n1 * n2 + 1):
            assert math.isclose(tests._exact_u(n1, n2, at), min(1, 2 * np.mean([x <= min(at, n1 * n2 - at) for x in seen]))), (n1, n2, at)
    # No size from which another formula is used: the exact tail of large groups agrees with the normal one.
    n1, n2 = 8, 20_000
    sd = math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    near = 2 * 0.5 * math.erfc((1.5 * sd - 0.5) / sd / math.sqrt(2))
    assert math.isclose(tests._exact_u(n1, n2, n1 * n2 / 2 - 1.5 * sd), near, rel_tol=0.02)


def test_anova_counts_every_gene_and_winsorises(spark):
    sg, samples, genes = blocks_of(spark, lift=3.0, genes=12)
    more = genes.union(frame(spark, [("none",), ("nothing",)], "orf string"))
    got = {r.orf: r for r in tests.anova(sg, samples, more, alpha=10.0).collect()}
    assert (got["none"].fstat, got["none"].pval, got["none"].msr, got["none"].status) == (-1.0, 1.0, 0.0, "TA sites <= 1")
    p = sorted(r.pval for r in got.values())
    for r in got.values():  # all genes are tests of the correction
        assert math.isclose(r.padj, min(1, min(x * len(p) / (np.searchsorted(p, x, "right")) for x in p if x >= r.pval)))
    pdf = sg.toPandas().merge(samples.toPandas(), on="sample_id")
    own = pdf[pdf.orf == "g0"]
    top, second = sorted(own["count"].unique())[-1:-3:-1]
    own = own.assign(count=own["count"].where(own["count"] != top, second))
    x = [v["count"].to_numpy() for _, v in own.groupby("condition")]
    m = np.concatenate(x).mean()
    winz = {r.orf: r for r in tests.anova(sg, samples, more, alpha=10.0, winz=True).collect()}["g0"]
    assert math.isclose(winz.msr, sum(len(v) * (v.mean() - m) ** 2 for v in x), rel_tol=1e-9)
    rows = tests.anova_report(sg, samples, more, ["ctrl", "exp"], refs=["ctrl"], alpha=10.0).collect()
    assert [r.orf for r in rows] == sorted(got) and rows[0]["Log 2 FC ctrl"] == 0.0
    r = {r.orf: r for r in rows}["g0"]
    assert math.isclose(r["Log 2 FC exp"], math.log2((r["Mean exp"] + 5) / (r["Mean ctrl"] + 5))) and r["Mean exp"] > r["Mean ctrl"]


def test_tests_between_strains(spark):
    """Genes lie elsewhere in the second strain, and have another number of sites; genes of one strain only go."""
    rng = np.random.default_rng(7)
    genes = [("c1", f"g{i}", 100 * i, 100 * i + 90, "+") for i in range(6)]
    other = [("c1", f"g{i}", 150 * i + 7, 150 * i + 120, "+") for i in range(1, 7)]
    schema, rows = "contig string, orf string, start long, end long, strand string", "sample_id string, contig string, position long, count double"
    ctrl = frame(spark, [(f"a{k}", "c1", p, float(rng.geometric(0.05))) for k in range(2) for p in range(0, 600, 5)], rows)
    exp = frame(spark, [(f"b{k}", "c1", p, float(rng.geometric(0.05)) * (20 if 157 <= p <= 270 else 1)) for k in range(2) for p in range(0, 1200, 7)], rows)
    sg = tests.strain_sites(ctrl, frame(spark, genes, schema), exp, frame(spark, other, schema))
    assert {r.orf for r in sg.select("orf").distinct().collect()} == {f"g{i}" for i in range(1, 6)}
    groups = frame(spark, [("a0", False), ("a1", False), ("b0", True), ("b1", True)], "sample_id string, is_exp boolean")
    got = {r.orf: r for r in tests.resampling(sg, groups, 500, "pooled").collect()}
    assert got["g1"].pval < 0.02 and got["g1"].lfc > 3 and np.mean([got[f"g{i}"].pval for i in range(2, 6)]) > 0.1
    wild = frame(spark, [("g", p, s, float(c)) for s, x in (("a", (1, 2, 3, 900)), ("b", (4, 5, 6, 7))) for p, c in enumerate(x)], "orf string, position long, sample_id string, count double")
    two = frame(spark, [("a", False), ("b", True)], "sample_id string, is_exp boolean")
    assert tests.resampling(wild, two, 50, "pooled", winz=True).first()["mean_ctrl"] == 2.25


def test_resampling(spark):
    sg, samples, _ = blocks_of(spark, lift=4.0, genes=12)
    groups = samples.select("sample_id", (F.col("condition") == "exp").alias("is_exp"), (F.col("k") % 2).cast("string").alias("library"))
    for mode in ("pooled", "site", "library"):
        got = {r.orf: r for r in tests.resampling(sg, groups, 400, mode, batch=100).collect()}
        again = {r.orf: r.pval for r in tests.resampling(sg.repartition(7), groups, 400, mode, batch=100).collect()}
        assert all(got[k].pval == again[k] for k in got) and all(r.done == 400 for r in got.values())
        assert sum(got[f"g{i}"].pval < 0.05 for i in range(5)) >= 4 and np.mean([r.pval for k, r in got.items() if int(k[1:]) >= 5]) > 0.2
    fast = {r.orf: r.done for r in tests.resampling(sg, groups, 1000, "site", adaptive=True, batch=100).collect()}
    assert min(fast.values()) < 1000 < max(fast.values()) + 1
    # A gene's permutations may be many rows of few values each: the p values do not depend on how they are dealt.
    few = {r.orf: r.pval for r in tests.resampling(sg, groups, 300, "site", cells=2000, work=1).collect()}
    assert few == {r.orf: r.pval for r in tests.resampling(sg.repartition(5), groups, 300, "site", cells=2000).collect()}
    try:
        tests.resampling(sg, groups.withColumn("library", F.when(F.col("is_exp"), "A").otherwise("B")), 100, "library")
        raise AssertionError("libraries that only one group has were accepted")
    except ValueError:
        pass
    own = tests.resampling(sg, groups, 100, "site", statistic=lambda a, b: np.median(b, axis=-1) - np.median(a, axis=-1))
    assert own.count() == 12


def test_adaptive_resampling_goes_on_with_new_permutations(spark):
    sg, samples, _ = blocks_of(spark, lift=9.0, genes=8)
    groups = samples.select("sample_id", (F.col("condition") == "exp").alias("is_exp"))
    got = {r.orf: r for r in tests.resampling(sg, groups, 400, "pooled", adaptive=True, batch=100).collect()}
    assert all(got[f"g{i}"].done == 400 and got[f"g{i}"].pval < 0.01 for i in range(5)) and all(r.done in (4, 40, 400) for r in got.values())
    # Counted again by hand: 20, 180, 500, 500, 500 and 300 permutations, each part with a seed of its own.
    got = {r.orf: r for r in tests.resampling(sg, groups, 2000, "pooled", adaptive=True).collect()}
    exp = {r.sample_id: r.is_exp for r in groups.collect()}
    reached = set()
    for orf, rows in sg.toPandas().sort_values(["position", "sample_id"]).groupby("orf"):
        counts, x = rows["count"].to_numpy(), rows["sample_id"].map(exp).to_numpy(bool)
        observed, done, two = abs(counts[x].mean() - counts[~x].mean()), 0, 0
        for lo, size in ((0, 20), (20, 180), (200, 500), (700, 500), (1200, 500), (1700, 300)):
            seen = tests._permute(counts, x, x, "pooled", size, np.random.default_rng([0, lo, *orf.encode()]))
            done, two = done + size, two + int((abs(seen[:, x].mean(axis=1) - seen[:, ~x].mean(axis=1)) >= observed - 1e-12).sum())
            if done in (20, 200) and two >= 2:
                break
        reached.add(done)
        assert got[orf].done == done and math.isclose(got[orf].pval, two / done), orf
    assert {20, 2000} <= reached


def test_permutations_stay_in_their_cells():
    counts, site = np.arange(12.0), np.repeat([0, 1, 2], 4)
    out = tests._permute(counts, site, site, "site", 50, np.random.default_rng(0))
    assert (np.sort(out.reshape(50, 3, 4), axis=2) == counts.reshape(3, 4)).all() and len(np.unique(out, axis=0)) > 30


def test_zinb(spark):
    sg, samples, _ = blocks_of(spark, lift=4.0, genes=24)
    got = {r.orf: r for r in tests.zinb(sg, sg.filter("position >= 5000").select("sample_id", "position", "count"), samples).collect()}
    assert sum(got[f"g{i}"].padj < 0.05 for i in range(5)) >= 4 and all(r.lrt >= 0 for r in got.values()) and np.mean([got[f"g{i}"].padj < 0.05 for i in range(5, 24)]) < 0.3
    genes = sg.select("orf").distinct().union(frame(spark, [("none",)], "orf string"))
    rows = samples.withColumn("strain", F.when(F.col("k") % 3 == 0, "x").otherwise("y"))
    counts = sg.filter("position >= 5000").select("sample_id", "position", "count")
    report = {r.orf: r for r in tests.zinb_report(sg.filter("orf < 'g2'"), counts, rows, genes.filter("orf < 'g2' OR orf = 'none'"), ["ctrl", "exp"], interactions=["strain"]).collect()}
    assert report["none"].status.startswith("TA sites <= 1") and report["none"].pval == 1 and all(r.df == 2 for r in report.values() if r.status == "-")
    assert {c for c in report["none"].asDict() if c.startswith("Mean ")} == {"Mean x_ctrl", "Mean y_ctrl", "Mean x_exp", "Mean y_exp"}
    pdf = pd.DataFrame({"condition": ["a", "a", "b", "b", "c", "c"], "batch": ["1", "2"] * 3, "size": [1, 5, 3, 4, 9, 6]})
    shapes = [tuple(x.shape[1] for x in tests.zinb_designs(pdf, *args)) for args in (([], []), (["batch"], []), ([], ["batch"]), (["size"], ["batch"]))]
    assert shapes == [(1, 3), (2, 4), (4, 6), (5, 6)]
    pi, r, mu = normalise.fit_zinb(np.array([0.0, 1, 2, 3, 4, 5]), np.array([600.0, 80, 90, 80, 60, 40]))
    assert 0.4 < pi < 0.65 and 1.5 < mu < 3.5 and r > 0


def test_expected_run_by_enumeration():
    for n, p in ((3, 0.3), (6, 0.5), (9, 0.2)):
        total = 0.0
        for bits in itertools.product((0, 1), repeat=n):
            longest = max((len(list(g)) for k, g in itertools.groupby(bits) if not k), default=0)
            total += longest * p ** sum(bits) * (1 - p) ** (n - sum(bits))
        assert math.isclose(essentiality.expected_run(n, p), total, rel_tol=1e-9)


def test_blocked_hmm_is_the_sequential_one(spark):
    rng = np.random.default_rng(2)
    counts = rng.geometric(0.05, 200) * (rng.random(200) < 0.7)
    counts[80:110] = 0
    df = frame(spark, [("x", "c1", 10 * i, float(c)) for i, c in enumerate(counts)], "condition string, contig string, position long, count double")
    whole = essentiality.hmm(df, 1000).orderBy("position").toPandas()
    cut = essentiality.hmm(df, 10).orderBy("position").toPandas()
    assert (whole.state == cut.state).all() and np.allclose(whole[["es", "gd", "ne", "ga"]], cut[["es", "gd", "ne", "ga"]], atol=1e-9)
    assert np.allclose(whole[["es", "gd", "ne", "ga"]].sum(axis=1), 1) and (whole.state[82:108] == "ES").mean() > 0.8
    par = essentiality.hmm_parameters(df).first()
    p, a, start = essentiality.hmm_model(par["m"], par["pins"])
    e = essentiality._emissions(counts.astype(float), p)
    best = None
    for path in itertools.product(range(4), repeat=5):  # the first sites by brute force
        s = start[path[0]] + e[0, path[0]] + sum(a[path[i - 1], path[i]] + e[i, path[i]] for i in range(1, 5))
        best = max(best, (s, path)) if best else (s, path)
    short = essentiality.block_states(e[:5], a, start, np.zeros(4), np.zeros(4), np.zeros(4), best[1][-1])[0]
    assert tuple(short) == best[1]
    # One site at a time, for blocks of every small length with and without a start.
    for n in (1, 2, 3, 7, 10, 23):
        for s in (start, None):
            total, top, steps = np.eye(4), np.where(np.eye(4) > 0, 0.0, -np.inf), range(n)
            if s is not None:
                total, top, steps = np.tile(np.exp(s + e[0]), (4, 1)), np.tile(s + e[0], (4, 1)), range(1, n)
            for i in steps:
                total, top = total @ np.exp(a) * np.exp(e[i]), (top[:, :, None] + a).max(1) + e[i]
            got = essentiality.block_transfer(e[:n], a, s)
            assert np.allclose(got[0], np.log(total)) and np.allclose(got[1], top)


def test_gumbel_and_gaps(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i}", 40, int(x), int(r), int(r * 20), 800, float(x / 40)) for i, (x, r) in enumerate(zip(rng.integers(15, 30, 60), rng.integers(2, 6, 60)))]
    rows += [(f"e{i}", 40, 0, 40, 800, 800, 0.0) for i in range(6)] + [("tiny", 1, 0, 1, 2, 2, 0.0)]
    blocks = frame(spark, rows, "orf string, n long, k long, max_run long, gap_span long, span long, theta double")
    got = {r.orf: r for r in essentiality.gumbel(blocks, samples=100, burnin=20, chains=2, limit=None).collect()}
    assert got["tiny"].call == "S" and all(got[f"e{i}"].zbar > 0.9 for i in range(6)) and np.mean([got[f"g{i}"].zbar for i in range(60)]) < 0.1
    assert all(r.ratio is None if r.call == "S" else r.ratio >= 0.9 for r in got.values())
    fine = essentiality.gumbel(blocks, samples=400, burnin=50, rounds=4)
    assert fine.agg(F.max("ratio")).first()[0] <= 1.1
    try:  # steps so small that no chain leaves its start
        between = frame(spark, [(f"m{i}", 40, 9, 8 + i, 160 + 20 * i, 800, 0.2) for i in range(12)], "orf string, n long, k long, max_run long, gap_span long, span long, theta double")
        essentiality.gumbel(blocks.union(between), samples=20, burnin=0, limit=1.1, rounds=1, step=1e-9)
        raise AssertionError("chains that do not mix were accepted")
    except RuntimeError:
        pass
    p = {r.orf: r.pval for r in essentiality.griffin(blocks, 0.5).collect()}
    assert p["e0"] < 1e-6 < p["g0"]


def test_posteriors_and_intervals(spark):
    draws = interactions.truncated_posterior(50, 20.0, 9.0, 20.0, 9.0, 4000, np.random.default_rng(0))
    lo, hi = interactions.hdi(draws)
    assert abs(draws.mean() - 20) < 0.3 and lo < 20 < hi and draws.min() >= 0
    sg, samples, _ = blocks_of(spark, lift=4.0)
    cells = samples.select("sample_id", F.element_at(F.array(*[F.lit(c) for c in ("A1", "A2", "A2", "B1", "B2", "B2")]), F.col("k") + 1).alias("cell"))
    got = interactions.genetic_interactions(sg, cells, samples=500).toPandas()
    assert len(got) == 30 and got.prob_rope.between(0, 1).all() and (got.lower <= got.delta).all() and (got.delta <= got.upper).all()


def test_ttn_against_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{i % 12}", float(rng.geometric(0.05)), int(rng.integers(0, 16)), int(rng.integers(0, 16))) for i in range(400)]
    got, beta = ttn.ttn_fitness(frame(spark, rows, "orf string, count double, up int, down int"))
    coef = {r.orf: r.coef for r in got.collect()}
    pdf = pd.DataFrame(rows, columns=["orf", "count", "up", "down"])
    y = np.log10(pdf["count"] + 0.5)
    y = (y - y.mean()).to_numpy()
    g = pd.get_dummies(pdf.orf).astype(float)
    x = np.zeros((len(pdf), 256))
    np.add.at(x, (np.arange(len(pdf)), pdf.up), 1)
    np.add.at(x, (np.arange(len(pdf)), pdf.down), 1)
    full = np.column_stack([g.to_numpy(), x])
    want = full @ np.linalg.lstsq(full, y, rcond=None)[0]
    beta = np.array(beta.first()["beta"])
    fit = np.array([coef[o] for o in pdf.orf]) + beta[pdf.up] + beta[pdf.down]
    assert np.allclose(fit, want, atol=1e-5)
    # Two samples in one plan are two samples by themselves.
    both = [(s, g, c * k, u, d) for s, k in (("a", 1), ("b", 3)) for g, c, u, d in rows]
    keyed = {(r.sample_id, r.orf): (r.coef, r.pval, r.padj) for r in ttn.ttn_fitness(frame(spark, both, "sample_id string, orf string, count double, up int, down int"), ["sample_id"])[0].collect()}
    for s, k in (("a", 1), ("b", 3)):
        for r in ttn.ttn_fitness(frame(spark, [(g, c * k, u, d) for g, c, u, d in rows], "orf string, count double, up int, down int"))[0].collect():
            assert np.allclose(keyed[s, r.orf], (r.coef, r.pval, r.padj), atol=1e-6)


def test_gene_sets(spark):
    edges = frame(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], "child string, parent string")
    closed = {(r.term, r.ancestor) for r in genesets.ancestors(edges).collect()}
    assert ("d", "a") in closed and len(closed) == 4 + 5
    results = frame(spark, [(f"g{i}",) for i in range(20)], "orf string")
    hits = frame(spark, [(f"g{i}",) for i in range(5)], "orf string")
    assoc = frame(spark, [(f"g{i}", "t1") for i in range(4)] + [(f"g{i}", "t2") for i in range(10, 16)] + [("g19", "solo")], "orf string, term string")
    got = {r.term: r for r in genesets.fet(results, hits, assoc).collect()}
    m, n, extra = 20, 5, int(20 * 2 / 5)
    want = sum(math.comb(4 + extra, x) * math.comb(m - 4 - extra, n - x) for x in range(4 + 2 + 1, 6)) / math.comb(m, n)
    assert set(got) == {"t1", "t2"} and math.isclose(got["t1"].pval, want, abs_tol=1e-12) and got["t1"].k == 4
    ranked = frame(spark, [(f"g{i}", 20.0 - i, i + 1) for i in range(20)], "orf string, score double, rank int")
    es = {r.term: r for r in genesets.gsea(ranked, assoc, n_perm=300).collect()}
    assert es["t1"].es == 1.0 and es["t1"].pval < 0.05 and es["t2"].pval > es["t1"].pval


def test_dose_response_is_exact_on_a_plane(spark):
    rows = []
    for g, (b0, b1, b2) in {"x": (-0.3, 0.2, 0.1), "y": (-0.5, 0.0, -0.2)}.items():
        for e in (0.1, 0.4, 0.7, 1.0):
            for dose in (0.25, 0.5, 1.0, 2.0):
                y = b0 + b1 * e + b2 * math.log2(dose)
                a = 10**y / (1 + 10**y)
                rows.append((g, e, dose, math.atanh((a - 0.01) / 0.99)))
    got = {r.orf: r for r in crispri.dose_response(frame(spark, rows, "orf string, efficacy double, dose double, abundance double")).collect()}
    assert math.isclose(got["x"].coef_dose, 0.1, abs_tol=1e-9) and math.isclose(got["y"].coef_dose, -0.2, abs_tol=1e-9) and math.isclose(got["x"].intercept, -0.3, abs_tol=1e-9)


def test_mismatch_search(spark):
    rows = frame(spark, [("a", "TTTACGTACG"), ("b", "TTTACCTA"), ("c", "TTTACC"), ("d", "GGACGT"), ("e", None)], "id string, seq string")
    near = {r.id: r.at for r in rows.select("id", reads.find_with_mismatches(F.col("seq"), "ACGT", 1).alias("at")).collect()}
    assert near == {"a": 3, "b": 3, "c": -1, "d": 2, "e": -1}
    old = {r.id: r.at for r in rows.select("id", reads.find_with_mismatches(F.col("seq"), "ACTT", 1, legacy_range=True).alias("at")).collect()}
    assert old["d"] == -1
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ACGT"), int(n))) for n in rng.integers(0, 150, 200)] + ["", "é" + "ACGT" * 40]
    for pattern in ("ACG", "ACGTAC", "A" * 5 + "C", "ACGT" * 18):
        for most in (0, 1, 2):
            data, offs = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            for less in (0, 1):
                want = [next((i for i in range(len(x) - len(pattern) + 1 - less) if sum(a != b for a, b in zip(x[i:], pattern)) <= most), -1) for x in texts]
                assert reads.first_hits(data, offs, pattern, most, less).tolist() == want


def test_intervals_of_all_lengths_meet_once(spark):
    rng = np.random.default_rng(3)
    spans = lambda n: [(int(a), int(a + 10 ** rng.uniform(0, 7))) for a in rng.integers(0, 3_000_000, n)]
    left, right = spans(120) + [(0, 100_000_000), (511, 512), (4095, 4096)], spans(120) + [(0, 90_000_000), (512, 512), (4096, 9000)]
    a = frame(spark, [("c1", i, s, e) for i, (s, e) in enumerate(left)], "contig string, run_id int, start_pos long, end_pos long")
    b = frame(spark, [("c1", f"g{i}", s, e) for i, (s, e) in enumerate(right)], "contig string, orf string, start long, end long")
    got = Counter((r.run_id, r.orf) for r in joins.overlaps(a, b).collect())
    assert got == Counter((i, f"g{j}") for i, (s, e) in enumerate(left) for j, (x, y) in enumerate(right) if s <= y and x <= e)
    assert joins._in_bins_above(a, "start_pos", "end_pos", list(range(joins.LEVELS)), False).count() <= 2 * joins.LEVELS * len(left)
    assert joins._in_own_bins(a, "start_pos", "end_pos").count() <= 2 * len(left)


def test_normalisations(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{k}", "c1", i, float((rng.random() < 0.5) * rng.geometric(1 / (20 * (k + 1))))) for k in range(3) for i in range(400)]
    counts = frame(spark, rows, "sample_id string, contig string, position long, count double")
    for method in ("TTR", "nzmean", "totreads", "zinfnb", "betageom", "aBGC", "target"):
        out = normalise.normalize(counts, method).groupBy("sample_id").agg(F.avg("count").alias("m")).toPandas()["m"]
        assert len(out) == 3 and out.max() / out.min() < 1.5, method
    ranks = normalise.normalize(counts, "quantile").groupBy("sample_id").agg(F.countDistinct("count").alias("n")).join(counts.groupBy("sample_id").agg(F.countDistinct("count").alias("m")), "sample_id")
    assert ranks.filter("n <> m").isEmpty()
    assert normalise.normalize(counts, "what").exceptAll(counts).isEmpty()


def test_empty_samples_stay(spark):
    """A sample without hits keeps its rows and zeros under every method, and does not change the others' factors."""
    rng = np.random.default_rng(6)
    full = [(f"s{k}", "c1", 10 * i, float((rng.random() < 0.5) * rng.geometric(1 / (20 * (k + 1))))) for k in range(2) for i in range(300)]
    both = frame(spark, full + [("none", "c1", 10 * i, 0.0) for i in range(300)], "sample_id string, contig string, position long, count double")
    alone, genes = both.filter("sample_id <> 'none'"), both.withColumn("orf", F.concat(F.lit("g"), (F.col("position") / 300).cast("int").cast("string")))
    for method in normalise.METHODS:
        out = normalise.normalize(both, method, genes, "s0")
        sums = {r.sample_id: (r.n, r.s) for r in out.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("count").alias("s")).collect()}
        assert set(sums) == {"s0", "s1", "none"} and all(n == 300 for n, _ in sums.values()), method
        if method != "quantile":
            same = {r.sample_id: r.s for r in normalise.normalize(alone, method, genes.filter("sample_id <> 'none'"), "s0").groupBy("sample_id").agg(F.sum("count").alias("s")).collect()}
            assert sums["none"][1] == 0 and all(math.isclose(sums[k][1], v, rel_tol=1e-9) for k, v in same.items()), method
    loess = normalise.loess_correction(both).groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("count").alias("s")).toPandas().set_index("sample_id")
    assert (loess["n"] == 300).all() and loess["s"]["none"] == 0
    stats = {r.sample_id: r for r in aggregates.global_stats_for_rep(both).collect()}
    assert stats["none"].logit_z_perc == math.inf and stats["none"].nz_mean == 0


def test_enrichment_without_weights_or_misses(spark):
    ranked = frame(spark, [(f"g{i}", 0.0 if i < 3 else 5.0 - i, i + 1) for i in range(6)], "orf string, score double, rank int")
    members = frame(spark, [(f"g{i}", "zero") for i in range(3)] + [(f"g{i}", "all") for i in range(6)], "orf string, term string")
    got = {r.term: r.es for r in windows.running_enrichment(ranked, members, p=1.0).collect()}
    assert got["zero"] == 0.0 and got["all"] == 1.0
    try:
        genesets.gsea(ranked, members, p=1.0, n_perm=100, max_genes=5)
        raise AssertionError("too many genes were accepted")
    except ValueError:
        pass


def test_uninduced_from_all_samples(spark):
    counts = [("a", "d0", 0.0, 10), ("a", "d1", 1.0, 30), ("a", "d2", 2.0, 20), ("b", "d0", 0.0, 5), ("b", "d1", 1.0, 5), ("b", "d2", 2.0, 5), ("c", "d1", 1.0, 7)]
    got = {r.sgrna: r.uninduced for r in crispri.estimated_uninduced(frame(spark, counts, "sgrna string, sample string, dose double, count long")).collect()}
    raw = {"a": 10 * math.exp(2 * (10 + 1e-8) / (20 + 1e-8)), "b": 5 * math.exp(2 * 1e-8 / (5 + 1e-8)), "c": 0.0}
    assert all(math.isclose(got[k], v / sum(raw.values()), rel_tol=1e-9) for k, v in raw.items())


def test_derived_columns_are_computed_once(spark):
    import __spark_entry__ as e

    plan = e.queries()["rd15_barcode_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(upper") == 1


def test_site_reports_have_every_site(spark):
    import __spark_entry__ as e

    d = "/root/testdata/sf0.01"
    grid = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 1).alias("position")).distinct()
    want, queries = {r.position for r in grid.collect()}, e.queries()
    assert max(want) > 5199
    for name in ("rd9_read_counts", "rd9_read_counts_mme1", "rd10_template_counts"):
        assert {r.position for r in queries[name](spark, d).collect()} == want, name
    assert queries["rd12_preprocess_stats"](spark, d).first().sites == len(want)


def test_queries_take_every_sample_and_gene(spark):
    import __spark_entry__ as e
    d, queries = "/root/testdata/sf0.001", e.queries()
    rows = lambda name: {tuple(r) for r in queries[name](spark, d).collect()}
    samples = {r[0] for r in spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus", F.lit("_"), (F.col("l_linenumber") % 2).cast("string"))).distinct().collect()}
    assert len(samples) > 1
    for name in ("j4_genes_in_ranges", "j5_overlap"):
        assert {r[0] for r in rows(name)} == samples, name
    assert len({r[0] for r in rows("w10_average_ranks")}) == len({r[0] for r in rows("a5_tosses")})
    genes = spark.read.parquet(f"{d}/part.parquet").count()
    for name in ("m7_tn5gaps", "m9_hmm_gene_calls"):
        found = rows(name)
        assert {r[0] for r in found} == samples and len(found) == len(samples) * genes, name
    for name in ("m12_ttn_fitness", "m13_fitness_defect"):
        assert {r.sample_id for r in queries[name](spark, d).select("sample_id").distinct().collect()} == samples, name
    assert {r.condition for r in queries["m9_hmm_genes"](spark, d).select("condition").distinct().collect()} == {x[0] for x in samples}
    # What a plan reads of the given tables is read when it is built; then come the written tables of runs, calls and corrections.
    scans = lambda name: queries[name](spark, d)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans("m9_hmm_gene_calls") <= 4 and all(scans(name) <= 8 for name in ("m7_tn5gaps", "m14_fet", "m16_ontology_enrichment"))


def test_models_use_all_draws_counts_and_depths(spark, monkeypatch):
    from lociq.plans import model_queries as m

    given = {}
    for module, name in ((m.tests, "resampling"), (m.essentiality, "gumbel"), (m.interactions, "genetic_interactions"), (m.tests, "fitness_defect"), (m.genesets, "gsea")):
        monkeypatch.setattr(module, name, lambda *a, name=name, **k: given.update({name: k}) or spark.range(1))
    for name in ("_blocks", "_ranked", "_groups", "site_gene"):
        monkeypatch.setattr(m, name, lambda *a, **k: spark.range(1).selectExpr("'N' sample_id", "'g' orf", "0 k", "0 n", "0 max_run", "0 gap_span", "0 span", "0 theta", "0D count"))
    d = "/root/testdata/sf0.001"
    for f in (m.m2_resampling, m.m5_gumbel, m.m11_genetic_interactions, m.m13_fitness_defect, m.m15_gsea):
        f(spark, d)
    assert given["resampling"]["times"] == given["genetic_interactions"]["samples"] == given["fitness_defect"]["draws"] == given["gsea"]["n_perm"] == 10_000
    assert given["gumbel"]["samples"] == 10_000 and given["gumbel"]["burnin"] == 500 and given["gumbel"].get("chains", 4) == 4
    monkeypatch.undo()
    counts = spark.range(1_000_000).select(F.col("id").cast("double").alias("count"), F.lit(1).alias("n")).union(frame(spark, [(2e6, 900_000_000)], "count double, n long"))
    found = tests.fitness_defect(frame(spark, [("g", 1, 5.0)], "orf string, n long, sum double"), counts, draws=10).first()
    assert found.expected > 1e6
    began = time.perf_counter()
    chain = frame(spark, [(f"t{i}", f"t{i + 1}") for i in range(100)], "child string, parent string")
    assert genesets.ancestors(chain).count() == 101 * 102 // 2
    ring = frame(spark, [(f"t{i}", f"t{(i + 1) % 9}") for i in range(9)] + [("x", "t0"), ("t3", "t3")], "child string, parent string")
    closed = genesets.ancestors(ring)
    assert closed.count() == closed.distinct().count() == 9 * 9 + 10 and time.perf_counter() - began < 90


def test_samples_without_hits_or_gaps(spark):
    """Each keeps all its rows, with defined values, and does not touch the others."""
    rng = np.random.default_rng(8)
    good = [float((rng.random() < 0.4) * rng.geometric(0.1)) for _ in range(60)]
    tracks = {"good": good, "none": [0.0] * 60, "full": [float(rng.geometric(0.1)) for _ in range(60)], "ones": [1.0] * 60}
    rows = [(k, "c1", 10 * i, v) for k, values in tracks.items() for i, v in enumerate(values)]
    track = frame(spark, rows, "condition string, contig string, position long, count double")
    alone = essentiality.hmm(track.filter("condition = 'good'"), 20).orderBy("position").toPandas()
    found = essentiality.hmm(track, 20).orderBy("position").toPandas()
    assert found.groupby("condition").size().to_dict() == dict.fromkeys(tracks, 60)
    assert found[["es", "gd", "ne", "ga"]].notna().all().all() and np.allclose(found[["es", "gd", "ne", "ga"]].sum(1), 1)
    assert (found[found.condition == "none"].state == "ES").all() and np.allclose(found[found.condition == "good"][["es", "ne"]].to_numpy(), alone[["es", "ne"]].to_numpy())
    par = {r.condition: (r.m, r.pins) for r in essentiality.hmm_parameters(track).collect()}
    assert par["none"] == (1.0, 0.0) and par["full"][1] == 1.0 and essentiality.hmm(track.limit(0), 20).count() == 0

    genes = frame(spark, [("c1", "g1", 0, 95), ("c1", "g2", 300, 420), ("c1", "off", 9000, 9100)], "contig string, orf string, start long, end long")
    own = track.withColumnRenamed("condition", "sample_id")
    got = {(r.sample_id, r.orf): r for r in essentiality.gaps(windows.runs(own, ["sample_id", "contig"]), genes, essentiality.insertion_rates(own, ["sample_id"]), ["sample_id"]).collect()}
    assert len(got) == 12 and all(math.isfinite(r.pval) and math.isfinite(r.padj) for r in got.values())
    assert all(got[s, g].pval == 1 and got[s, g].call == "Non-essential" for s in ("none", "full", "ones") for g in ("g1", "g2", "off")) and got["none", "g1"].run_length == 60

    blocks = frame(spark, [("a", 30, 30, 0), ("b", 5, 5, 0), ("e", 0, 0, 0)], "orf string, k long, n long, max_run long")
    for theta, want in ((1.0, {"a": 0, "b": 0, "e": 0}), (0.0, {"a": 30, "b": 5, "e": 0}), (None, {"a": 30, "b": 5, "e": 0})):
        seen = essentiality.griffin(blocks, theta).collect()
        assert {r.orf: r.expected_run for r in seen} == want and all(r.pval == 1 for r in seen)


def test_joins_of_sites_and_genes_broadcast_no_side(spark):
    """The planner took the grid times the samples, and all genes, for small."""
    grid = frame(spark, [("c", i) for i in range(1, 40)], "contig string, position long")
    counts = frame(spark, [("s1", "c", 3, 2.0), ("s2", "c", 3, 5.0), ("s1", "c", 99, 1.0), ("other", "c", 4, 1.0)], "sample_id string, contig string, position long, count double")
    filled = joins.zero_fill(grid, counts, frame(spark, [("s1",), ("s2",), ("s3",)], "sample_id string"))
    assert filled.count() == 39 * 3 and sorted(map(tuple, filled.filter("count > 0").collect())) == [("s1", "c", 3, 2.0), ("s2", "c", 3, 5.0)]
    assert "BuildLeft" not in filled.filter("count > 0")._jdf.queryExecution().executedPlan().toString()
    genes = frame(spark, [("c", "g1", 2, 12, "+"), ("c", "g2", 3, 30, "-")], "contig string, orf string, start long, end long, strand string")
    runs = frame(spark, [("c", 0, 1, 5)], "contig string, run_id long, start_pos long, end_pos long")
    for df in (joins.assign_sites(grid, genes), joins.overlaps(runs, genes)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_blocks_from_sites_are_those_from_rows(spark):
    """Samples are added up before sites meet genes: no shuffle by gene and site."""
    grid = frame(spark, [("c", i) for i in range(1, 60)], "contig string, position long")
    counts = frame(spark, [(s, "c", i, float(i % 4)) for s, step in (("s1", 5), ("s2", 7)) for i in range(2, 60, step)], "sample_id string, contig string, position long, count double")
    genes = frame(spark, [("c", "g1", 2, 22, "+"), ("c", "g2", 10, 50, "-"), ("c", "far", 500, 600, "+")], "contig string, orf string, start long, end long, strand string")
    table = joins.site_matrix(grid, counts, ["s1", "s2"])
    rows = joins.assign_sites(joins.by_sample(table, ["s1", "s2"]), genes).select("sample_id", "orf", "position", "count")
    tosses = aggregates.tosses_of_sites(table, genes)
    assert sorted(map(tuple, tosses.select("orf", "position", "total", "hit").collect())) == sorted(map(tuple, aggregates.site_tosses(rows).collect()))
    found, want = (sorted(map(tuple, df.collect())) for df in (aggregates.block_stats(tosses, genes), aggregates.gene_block_stats(rows, genes)))
    assert found == want and len(found) == 3
    runs = {r.orf: (r.max_run, r.gap_span) for r in aggregates.max_runs(tosses).collect()}
    assert all((r[found_at], r[found_at + 1]) == runs[r[0]] for r in found if r[0] != "far" for found_at in [aggregates.block_stats(tosses, genes).columns.index("max_run")])


def test_null_differences_are_those_of_permutations():
    """Drawn sums have the distribution of permuted counts in all three modes, at a fraction of the time."""
    rng = np.random.default_rng(5)
    counts = rng.poisson(3, 840) * (rng.random(840) < 0.4) * 1.0
    site, exp = np.repeat(np.arange(105), 8), np.tile(np.arange(8) >= 4, 105)
    library = np.tile(np.arange(8) % 2, 105)
    for mode, cell in (("pooled", np.zeros(840, int)), ("site", site), ("library", library)):
        began = time.process_time()
        seen = tests._permute(counts, site, library, mode, 2000, np.random.default_rng(1))
        want, slow = tests.mean_difference(seen[:, ~exp], seen[:, exp]), time.process_time() - began
        began = time.process_time()
        got, fast = tests._null_differences(counts, exp, cell, 2000, np.random.default_rng(2)), time.process_time() - began
        print(mode, round(slow, 3), round(fast, 3))
        assert abs(got.mean() - want.mean()) < 0.02 and abs(got.std() / want.std() - 1) < 0.08
        assert np.abs(np.quantile(got, [0.05, 0.25, 0.75, 0.95]) - np.quantile(want, [0.05, 0.25, 0.75, 0.95])).max() < 0.15 * want.std()
        assert fast < slow
    two = np.unique(tests._null_differences(np.array([1.0, 2.0, 4.0, 7.0]), np.array([False, True, False, True]), np.array([0, 0, 1, 1]), 500, rng))
    assert two.tolist() == [-2.0, -1.0, 1.0, 2.0]  # every split, and no other


def test_windows_over_genes_shuffle_no_rows_a_sample(spark):
    """Rows are dealt by gene before samples become rows, and no exchange lies above that."""
    from lociq.plans import queries as plans

    for name in ("f8_winsorize", "f9_winsorize_resampling", "w10_average_ranks"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("posexplode(")], name
