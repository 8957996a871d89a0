"""Exact neighbours by streaming the index through blocks of queries: the same as in double precision, in bounded memory, in many tasks."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwalk.operators import knn as K


def brute(qi, q, xi, x, k, metric):
    out, q, x = [], q.astype(np.float64), x.astype(np.float64)
    for i, v in zip(qi, q):
        with np.errstate(all="ignore"):
            s = np.round((x * v).sum(1) if metric == "ip" else -((x - v) ** 2).sum(1), 6)
        at = np.flatnonzero((s > -np.inf) & (xi != i))
        out.append([(int(xi[j]), float(s[j])) for j in at[np.lexsort((xi[at], -s[at]))][:k]])
    return out


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("kind", ["close", "ties", "odd"])
def test_as_in_double_precision(metric, kind):
    """Scores closer than single precision tells apart, ties, and values that overflow or are no numbers."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    if kind == "close":
        x = np.repeat(x[:30], 30, axis=0) + rng.integers(0, 3, (900, 8)).astype(np.float32) * 1e-6
    elif kind == "ties":
        x = np.round(x)
    else:
        x[rng.integers(0, 900, 40), rng.integers(0, 8, 40)] = rng.choice([np.nan, np.inf, -np.inf, 1e25, -3e38], 40)
    ids = rng.permutation(5000)[:900]
    near = K.Nearest(ids[:300], x[:300], None, 7, metric, True)
    for i in range(0, 900, 130):
        near.feed(ids[i : i + 130], x[i : i + 130], None)
    got = [[(int(n), float(s)) for n, s in zip(a, b) if s > -np.inf] for a, b in zip(near.found, near.score)]
    assert got == brute(ids[:300], x[:300], ids, x, 7, metric)


def test_memory_does_not_grow_with_the_index():
    rng = np.random.default_rng(2)
    q = rng.normal(size=(1024, 64)).astype(np.float32)
    near = K.Nearest(np.arange(1024), q, None, 10, "ip", True)
    tracemalloc.start()
    for i in range(0, 60_000, 1000):
        near.feed(np.arange(i, i + 1000), rng.normal(size=(1000, 64)).astype(np.float32), None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20  # all scores of one piece of 1024 queries were 480 MB, four times over


def test_queries_of_one_block_are_several_tasks(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(3 * K.TASK_ROWS, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(m)], "vec_id long, embedding array<float>")
    plan = K.exact_knn(v, v, 2)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan and ", 3" in next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    some = K.exact_knn(v.where("vec_id < 20"), v, 2).orderBy("q", "rank").collect()
    want = brute(np.arange(20), m[:20], np.arange(len(m)), m, 2, "ip")
    assert [(r.n, r.score) for r in some] == [p for w in want for p in w]


def test_repeated_ids_of_queries_share_a_list(spark):
    v = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    got = K.exact_knn(v.where("vec_id = 0"), v.where("vec_id > 0"), 1).select("q", "n", F.col("rank")).collect()
    assert [(r.q, r.n, r["rank"]) for r in got] == [(0, 2, 1)]
