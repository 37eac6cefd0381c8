import math

import numpy as np
from lociq.functions import special as s


def test_against_closed_forms():
    assert np.allclose(s.lgamma([0.5, 1, 5, 20.5]), [math.lgamma(x) for x in (0.5, 1, 5, 20.5)], atol=1e-11)
    assert np.allclose(s.norm_sf([0, 1, -2, 5]), [0.5 * math.erfc(x / math.sqrt(2)) for x in (0, 1, -2, 5)], rtol=1e-10)
    assert np.allclose(s.norm_ppf([0.025, 0.5, 0.9]), [-1.959963984540054, 0, 1.2815515655446004], atol=1e-9)
    assert np.allclose(s.chi2_sf([3.0, 10.0], [2, 2]), [math.exp(-1.5), math.exp(-5)], rtol=1e-12)
    # F with d1 = 2 has a closed tail; t with one degree of freedom is Cauchy
    assert np.allclose(s.f_sf([1.0, 4.0], 2, 8), [(1 + 2 * f / 8) ** -4 for f in (1.0, 4.0)], rtol=1e-10)
    assert np.allclose(s.t_sf2([1.0, 3.0], 1), [1 - 2 * math.atan(x) / math.pi for x in (1.0, 3.0)], rtol=1e-10)
    assert abs(s.hypergeom_sf(1, 10, 4, 5) - sum(math.comb(4, k) * math.comb(6, 5 - k) for k in (2, 3, 4)) / math.comb(10, 5)) < 1e-12
    assert abs(float(s.binom_sf(2, 6, 0.3)) - sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(3, 7))) < 1e-12
