"""Draws that take less work than before: they have the law of the plain ones."""

import itertools

import numpy as np
from lociq.functions import special
from lociq.operators import genesets, interactions, tests


def _truncated(mun, sd, rng):
    """Quantiles of uniform numbers, one by one."""
    low = special.norm_sf(mun / sd)
    return np.maximum(mun + sd * special.norm_ppf(np.clip(low + rng.random(len(sd)) * (1 - low), 1e-15, 1 - 1e-15)), 0)


def test_posterior_draws_take_few_quantiles(monkeypatch):
    asked, plain = [], special.norm_ppf
    monkeypatch.setattr(special, "norm_ppf", lambda p: asked.append(np.size(p)) or plain(p))
    for n, mean, var, mu0, s20 in ((200, 8.5, 180.0, 8.0, 170.0), (3, 0.1, 0.3, 0.2, 20.0), (2, 0.0, 0.0, 0.0, 5.0), (4, -1.0, 2.0, -1.0, 2.0)):
        asked.clear()
        got = interactions.truncated_posterior(n, mean, var, mu0, s20, 40_000, np.random.default_rng(3))
        assert got.shape == (40_000,) and got.min() >= 0 and (sum(asked) < 400 or mean < 0)
        rng, k = np.random.default_rng(4), 1 + n
        s2 = 1 / rng.gamma(k / 2, 2 / (k * (s20 + (n - 1) * var + n / k * (mean - mu0) ** 2) / k), 40_000)
        want = _truncated((mu0 + n * mean) / k, np.sqrt(s2 / k), rng)
        assert special.norm_sf(np.zeros(1))[0] == 0.5 and np.abs(np.searchsorted(np.sort(got), np.quantile(want, [0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98])) / 40_000 - [0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98]).max() < 0.012


def test_laws_of_splits_are_those_of_all_permutations():
    rng = np.random.default_rng(6)
    counts = np.floor(rng.random((40, 4)) * 12) * (rng.random((40, 4)) < 0.5)
    for exp in (np.array([False, True, True, False]), np.array([True, False, False, False])):
        lo = np.array([0, 3, 14, 15, 20, 31, 36, 9])
        hi = np.array([2, 6, 17, 18, 20, 35, 37, 35])
        laws = tests._split_laws(counts, exp, lo, hi, 100_000)
        assert 4 not in laws and len(laws) >= 6
        for g, law in laws.items():
            own = counts[lo[g] : hi[g]]
            sums, k = np.zeros(1), int(exp.sum())
            for row in own:
                sums = np.add.outer(sums, [sum(x) for x in itertools.combinations(row, k)]).ravel()
                if len(sums) > 200_000:
                    break
            if len(sums) > 200_000:  # too many to list: many are drawn
                site = np.repeat(np.arange(len(own)), 4)
                seen = tests._exceedances("g", own.ravel(), np.tile(exp, len(own)), site, site, 0, 20_000, 500, "site", 0, tests.mean_difference)[1:] / 20_000
                assert all(abs(law[tests.OUTCOMES & bit > 0].sum() - p) < 0.02 for bit, p in zip((1, 2, 4), seen)), g
                continue
            e, c = k * len(own), (4 - k) * len(own)
            null = sums / e - (own.sum() - sums) / c
            observed = own[:, exp].sum() / e - own[:, ~exp].sum() / c
            want = [(np.abs(null) >= abs(observed) - 1e-9).mean(), (null <= observed + 1e-9).mean(), (null >= observed - 1e-9).mean()]
            assert np.allclose([law[tests.OUTCOMES & bit > 0].sum() for bit in (1, 2, 4)], want, atol=1e-12), g
    assert tests._split_laws(counts + 0.5, exp, lo, hi, 100_000) == {} and tests._split_laws(counts, exp, lo, hi, 1) == {}


def test_drawn_sums_are_those_of_samples_without_replacement():
    rng = np.random.default_rng(2)
    for values, k in ((np.array([0.0] * 9 + [1, 2, 2, 5, 7, 11, 3, 4, 9, 2.5]), 9), (np.array([3.0] * 6 + [1, 1, 8]), 4), (np.arange(12.0), 3), (np.array([0.0] * 20 + [4, 6]), 21), (np.full(5, 2.0), 3)):
        got = tests._drawn_sums(values, k, 20_000, rng)
        want = np.array([rng.permutation(values)[:k].sum() for _ in range(20_000)])
        assert len(got) == 20_000 and set(np.round(got, 9)) <= {round(float(x), 9) for x in ([sum(c) for c in itertools.combinations(values, k)] if len(values) < 20 else want)}
        assert all(abs((got <= x).mean() - (want <= x).mean()) < 0.02 for x in np.quantile(want, np.linspace(0, 1, 21)))


def test_large_cells_draw_no_number_of_each_count():
    class Plain(np.random.Generator):
        def multivariate_hypergeometric(self, *a, **k):
            raise AssertionError("numbers of each distinct count were drawn")

    rng = np.random.default_rng(1)
    counts = np.floor(rng.random(840) * 50) * (rng.random(840) < 0.3)
    assert len(tests._null_differences(counts, np.tile(np.arange(8) >= 4, 105), np.zeros(840, int), 500, Plain(np.random.PCG64(0)))) == 500


def test_random_places_are_all_as_likely():
    rng = np.random.default_rng(3)
    for n, size in ((6, 2), (6, 4), (200, 2), (200, 199), (5, 5)):
        found = [tuple(genesets.random_places(n, size, rng).tolist()) for _ in range(3000)]
        assert all(len(set(x)) == size and list(x) == sorted(x) and 0 <= x[0] and x[-1] < n for x in found)
        if n == 6:
            sets, times = np.unique(found, axis=0, return_counts=True)
            assert len(sets) == 15 and ((times - 200) ** 2 / 200).sum() < 40
        assert abs(np.mean([np.mean(x) for x in found]) - (n - 1) / 2) < 0.05 * n


def test_draws_of_gene_sets_keep_all_partitions(spark, monkeypatch):
    """Few bytes that make much work: adaptive execution does not join them into one task."""
    from pyspark.sql import DataFrame

    plans, plain = [], genesets.keep
    monkeypatch.setattr(genesets, "keep", lambda df, name: (plans.append((name, df)), plain(df, name))[1])
    ranked = spark.range(1, 41).selectExpr("concat('g', id) orf", "cast(id AS int) rank", "cast(20 - id AS double) score")
    sets = spark.range(1, 41).selectExpr("concat('g', id) orf", "concat('t', id % 4) term")
    assert genesets.gsea(ranked, sets, n_perm=1000).count() == 4
    drawn = next(df for name, df in plans if name == "drawn")
    assert isinstance(drawn, DataFrame) and "REPARTITION_BY_NUM" in drawn._jdf.queryExecution().executedPlan().toString()
