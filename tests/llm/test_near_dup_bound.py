import math

import numpy as np
import pytest

from lexikv.llm.near_dup import Settings


@pytest.mark.parametrize("percent", [85, 80])
def test_bound_counts_all_levels_and_the_cut(percent):
    s, p = Settings(percent=percent), percent / 100
    # a branch is lost at once or below: x = (1 - p + p x) ** branches
    below = np.polynomial.Polynomial([1 - p, p]) ** s.branches - np.polynomial.Polynomial([0, 1])
    lost = min(r.real for r in below.roots() if abs(r.imag) < 1e-9 and r.real > 0)
    cut = sum(math.comb(s.tokens, k) * p**k * (1 - p) ** (s.tokens - k) for k in range(s.agree))
    assert s.missed == pytest.approx((1 - p + p * lost) ** (s.trees * s.branches) + cut, rel=1e-6)
    assert s.missed < 2e-7
