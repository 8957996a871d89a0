"""Numbers of tables against full Gibbs sweeps over every customer."""

import numpy as np
import pytest

from loomwalk.llm import lm


def seat(n, weight, d, rng, sweeps):
    """Tables of one dish by seating each customer in turn; averaged over the second half of the sweeps."""
    at, sizes, seen = np.zeros(n, int), [n], []
    for s in range(sweeps):
        for i in range(n):
            sizes[at[i]] -= 1
            x = np.array(sizes, float)
            pull = np.cumsum(np.append(np.where(x > 0, x - d, 0), weight))
            k = int((pull <= rng.random() * pull[-1]).sum())
            if k == len(sizes):
                k = sizes.index(0) if 0 in sizes else k
                if k == len(sizes):
                    sizes.append(0)
            sizes[k] += 1
            at[i] = k
        if 2 * s >= sweeps:
            seen.append(sum(x > 0 for x in sizes))
    return np.mean(seen)


@pytest.mark.parametrize("n, weight", [(40, 3.0), (300, 30.0), (1500, 60.0)])
def test_draws_against_full_sweeps(n, weight):
    d = 0.7
    got = lm.draw_tables(np.full(400, n), np.full(400, weight), d, np.random.default_rng(1)).mean()
    assert abs(got / seat(n, weight, d, np.random.default_rng(2), max(60, 60_000 // n)) - 1) < 0.08


def test_scaling_limit_meets_the_exact_table():
    d, n = 0.7, lm.EXACT
    for weight in (0.5, 20.0, 120.0):
        a, b = (lm.draw_tables(np.full(4000, m), np.full(4000, weight), d, np.random.default_rng(3)).mean() for m in (n, n + 1))
        assert abs(a / b - 1) < 0.03


def test_weights_settle_with_many_customers():
    """The weight follows from the tables: further sweeps change nothing, at the size where few moves left 7,738 of 12,398 tables."""
    rng, d = np.random.default_rng(0), 0.7
    p = 1 / np.arange(1, 4001)
    p /= p.sum()
    c = rng.multinomial(20_000, p)
    c, p = c[c > 0], p[c > 0]
    weight = lambda t: (1 + d * t.sum()) * p
    one, more = (lm.gibbs(c, weight, d, np.random.default_rng(1), burn=b, keep=3).sum(axis=1).mean() for b in (4, 60))
    assert abs(one / more - 1) < 0.03


def test_pairs_of_large_ids_stay_apart():
    u, w = np.array([3, 2, 3, 2**40]), np.array([5, 2**32 + 5, 5, 7])
    key = lm.pair_keys(u, w)
    assert key[0] == key[2] and len(set(key.tolist())) == 3
    small = np.array([1, 2, 1]), np.array([2, 1, 2])
    assert len(set(lm.pair_keys(*small).tolist())) == 2
