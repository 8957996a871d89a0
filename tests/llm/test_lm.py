import math
import random
from collections import Counter

import numpy as np
import pytest

from loomwalk.llm import lm

from .helpers import documents, remainder, words

RNG = random.Random(11)
VOCAB = [f"w{int(RNG.paretovariate(0.8)) % 300}" for _ in range(2000)]


def corpus(n=120):
    return [(i, " ".join(RNG.choice(VOCAB) for _ in range(RNG.randint(0, 80)))) for i in range(n)]


ROWS = corpus() + [(500, None), (501, ""), (502, " \t"), (503, "Unseen WORDS only"), (504, "w1 " * 5000), (505, "W1 w1\nW1"), (3, "a repeated id")]


def base(rows):
    toks = [(i, [*words(t), "\n"]) for i, t in rows]
    c = Counter(w for i, ts in toks if remainder(i) != 1 for w in ts)
    n, v = sum(c.values()), len(c)
    return [(i, len(ts), sum(w in c for w in ts), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)) for i, ts in toks]


@pytest.mark.parametrize("slice_bytes", [500, 1 << 20])
def test_counts_and_base_scores(spark, slice_bytes):
    out = lm.score_documents(documents(spark, ROWS), slice_bytes=slice_bytes).collect()
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == sorted((i, n, k, t, round(b, 6)) for i, n, k, t, b in base(ROWS))
    assert all(r.held_out == (remainder(r.doc_id) == 1) for r in out)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_slices_do_not_change_counts_of_pairs(spark):
    """However the corpus is cut, the same pairs are counted; scores differ only by sampling."""
    a, b = (sorted((r.doc_id, r.score, r.n_tokens) for r in lm.score_documents(documents(spark, ROWS), slice_bytes=s).collect()) for s in (800, 1 << 20))
    for x, y in zip(a, b):
        assert abs(x[1] - y[1]) <= 0.05 * x[2] + 0.2


def test_repeated_runs_agree(spark):
    docs = documents(spark, ROWS)
    one, two = (sorted((r.doc_id, r.score) for r in lm.score_documents(docs).collect()) for _ in range(2))
    assert one == two


def test_no_training_rows_and_empty_table(spark):
    held = [(i, "a b") for i in range(200) if remainder(i) == 1][:5]
    for r in lm.score_documents(documents(spark, held)).collect():
        assert (r.train_tokens, r.n_known, r.base_score, round(r.score, 9)) == (0, 0, 0.0, 0.0)
    assert lm.score_documents(documents(spark, [])).count() == 0


def test_null_id(spark):
    (r,) = lm.score_documents(documents(spark, [(None, "a b")])).collect()
    assert r.doc_id is None and not r.held_out and r.n_tokens == 3


def test_probabilities_of_a_context_add_up_to_one():
    """With the true sums of tables, every context's words and the unknown word share one."""
    rng = np.random.default_rng(1)
    v, contexts = 40, 6
    c = rng.poisson(0.7, (contexts, v))
    t = np.stack([np.minimum(c, 1 + (rng.random(c.shape) * c).astype(int))])
    t = np.where(c > 0, np.maximum(t, 1), 0)
    n0 = t[0].sum(axis=0)
    r0 = np.where(n0 > 0, 1, 0)
    totals = lm.Totals(documents=3, tokens=int(c.sum()), words=v, words_once=10, words_twice=5, pairs_once=int((c == 1).sum()), pairs_twice=int((c == 2).sum()), customers=(int(n0.sum()),), tables=(int(r0.sum()),), start_tables=(0,))
    for u in range(contexts):
        p = lm.predictive(np.append(c[u], 0), np.append(t[0][u], 0), c[u].sum(), t[0][u].sum(), np.append(n0, 0), np.append(r0, 0), np.append(np.ones(v, bool), False), 0, totals, 1.0, 1.0)
        assert abs(p.sum() - 1) < 1e-9


def test_gibbs_against_the_exact_distribution():
    """Three customers of one dish: the chance of one, two, three tables follows from the weights of all seatings."""
    d, a = 0.5, 0.8
    weight = {1: a * (1 - d) * (2 - d), 2: 3 * a * a * (1 - d), 3: a**3}  # partitions of three customers by tables
    total = sum(weight.values())
    n = 40_000
    t = lm.gibbs(np.full(n, 3), lambda tables: np.full(n, a), d, np.random.default_rng(4), burn=12, keep=1)[0]
    for k, w in weight.items():
        assert abs((t == k).mean() - w / total) < 0.01


def test_gibbs_with_many_customers_opens_as_many_tables_as_needed():
    n = np.array([1, 2, 100, 5000])
    t = lm.gibbs(n, lambda tables: np.full(4, 500.0), 0.9, np.random.default_rng(0), burn=4, keep=1)[0]
    assert (t <= n).all() and t[0] == 1 and 400 < t[3] < 650


def test_first_tables_are_near_the_stationary_number():
    n, a, d = np.full(300, 400), 3.0, 0.6
    first = lm.first_tables(n, np.full(300, a), d, np.random.default_rng(1)).mean()
    later = lm.gibbs(n, lambda tables: np.full(300, a), d, np.random.default_rng(2), burn=150, keep=1)[0].mean()
    assert abs(first - later) < 0.2 * later


def test_packing():
    arrays = [np.array([], np.int64), np.array([0, 255, 256]), np.array([-5, 7]), np.arange(3, dtype=np.uint64) + np.uint64(1 << 63), np.array([True, False])]
    for a, b in zip(arrays, lm.unpack(lm.pack(*arrays))):
        assert a.tolist() == b.astype(a.dtype).tolist()
