"""Published results that stand on their own: fixed values, as printed by the surveyed package."""

import math

import pytest
from lociq.functions import special
from lociq.operators import windows

# Genes of the term, hits in it, expected, hits and genes with pseudo-counts, enrichment, p; 160 hits among 3,990 genes.
TERMS = [
    (38, 14, 1.52, 16, 87, 4.545, 3.344658646777723e-08), (119, 15, 4.77, 17, 168, 2.511, 0.00010379266669529569), (163, 17, 6.54, 19, 212, 2.225, 0.0002493532381030652),
    (123, 13, 4.93, 15, 172, 2.165, 0.0012470517978295356), (206, 17, 8.26, 19, 255, 1.852, 0.0026050341384100586), (1066, 58, 42.75, 60, 1115, 1.341, 0.0028147476256698673),
    (19, 3, 0.76, 5, 68, 1.812, 0.053520344393146936), (469, 25, 18.81, 27, 518, 1.297, 0.05724176473321933), (2, 1, 0.08, 3, 51, 1.442, 0.14625233544554442), (360, 16, 14.44, 18, 409, 1.095, 0.2807626991232051),
]
# Q of the six smallest of 119 p values, in order.
Q = [3.980143789665491e-06, 0.006175663668370094, 0.009891011778088253, 0.037099790985428684, 0.05582582790911903, 0.05582582790911903]
# Genes of the term, hits in it, genes and hits of its parents' union, enrichment, p (six decimals).
ONTOLOGY = [(40, 14, 1005, 37, 9.685, 0.0), (100, 20, 919, 42, 4.449, 0.0), (23, 11, 132, 15, 4.156, 0.0), (19, 10, 149, 17, 4.583, 1e-6), (281, 25, 1464, 53, 2.501, 2e-6), (166, 19, 290, 25, 1.34, 0.035698), (291, 8, 459, 9, 1.418, 0.100235)]
# Sites of the gene (five samples of two conditions), mean squares between and within, F, p.
ANOVA = [(7, 46.955108, 1030.829111, 0.045551, 0.832308), (35, 617.903517, 4563.341611, 0.135406, 0.713341), (42, 1792.396360, 2707.662090, 0.661972, 0.416795), (10, 10185.014585, 13128.021929, 0.775822, 0.382811), (27, 2.317114, 10001.911910, 0.000232, 0.987879), (5, 484.180978, 11144.255128, 0.043447, 0.836721)]


@pytest.mark.parametrize("row", TERMS)
def test_terms(row):
    size, hits, expected, k, n, enrichment, p = row
    assert (k, n) == (hits + 2, size + int(3990 * 2 / 160)) and math.isclose(160 * size / 3990, expected, abs_tol=6e-3)
    assert math.isclose((hits + 2) / (round(160 * size / 3990, 2) + 2), enrichment, abs_tol=6e-4) and math.isclose(special.hypergeom_sf(k, 3990, n, 160), p, rel_tol=1e-8)


@pytest.mark.parametrize("row", ONTOLOGY)
def test_ontology_terms(row):
    m, b, q, p, enrichment, pval = row
    assert math.isclose(((b + 1) / (p + 1)) / ((m + 1) / (q + 1)), enrichment, abs_tol=6e-4) and abs(special.hypergeom_sf(b - 1, q, m, p) - pval) < 6e-7


@pytest.mark.parametrize("row", ANOVA)
def test_anova_tails(row):
    sites, msr, mse, f, p = row
    assert math.isclose(msr / mse, f, abs_tol=6e-7) and math.isclose(float(special.f_sf(msr / mse, 1, 5 * sites - 2)), p, abs_tol=1.2e-4)


def test_corrections(spark):
    ps = [t[6] for t in TERMS[:6]] + [1.0] * 113
    got = windows.bh_fdr(spark.createDataFrame(list(enumerate(ps)), "i int, pval double")).collect()
    assert all(math.isclose(r.padj, Q[r.i] if r.i < 6 else 1.0, rel_tol=1e-9) for r in got) and len(got) == 119
