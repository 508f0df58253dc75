from math import lgamma

import numpy as np
from ledgerloom.llm import minhash


def test_pairs_at_the_threshold_are_rarely_dropped():
    """Exact chance, over all numbers of larger and smaller registers, that a pair of equal sizes at 0.8 is dropped."""
    registers, p = minhash.REGISTERS, float(minhash._p(np.array([0.1]))[0])
    more, less = (x.ravel() for x in np.meshgrid(np.arange(61), np.arange(61)))
    rest, n = registers - more - less, np.full(len(more), 1000.0)
    fact = np.array([lgamma(i + 1) for i in range(registers + 1)])
    chance = np.exp(fact[-1] - fact[more] - fact[less] - fact[rest] + (more + less) * np.log(p) + rest * np.log(1 - 2 * p))
    assert abs(chance.sum() - 1) < 1e-9
    assert chance[~minhash.likely(more, less, n, n, 0.8)].sum() < 5e-8
