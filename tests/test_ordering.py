"""Ordering, clusters and neighbours: goldens, brute force and properties."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwalk.operators import knn as K
from loomwalk.operators import order as O
from loomwalk.operators import stats as S

GRAPH = {0: [2, 5], 1: [0, 2], 2: [5, 0], 3: [4, 1], 4: [3, 6], 5: [0, 2], 6: [7, 4], 7: [6, 3]}


def table(spark, graph):
    return spark.createDataFrame(list(graph.items()), "q long, nn array<long>")


def clusters(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.cluster_id, r.pos)):
        out.setdefault(r.cluster_id, []).append(r.doc_id)
    return out


def walk(graph, cap):
    """One global walk, as specified."""
    unseen, out, cur = set(graph), {0: []}, None
    cluster = length = 0
    cur = min(unseen)
    unseen.discard(cur)
    out[0].append(cur)
    while unseen:
        step = next((x for x in graph[cur] if x in unseen), None)
        if step is None or length >= cap:
            step = min(unseen)
            cluster, length = cluster + 1, 0
        unseen.discard(step)
        out.setdefault(cluster, []).append(step)
        length += 1
        cur = step
    return out


def test_golden_cover_and_merge(spark):
    knn = table(spark, GRAPH)
    cover = O.greedy_cover(knn, cap=3)
    assert clusters(cover.collect()) == {0: [0, 2, 5], 1: [1], 2: [3, 4, 6], 3: [7]}
    assert clusters(O.merge_short(cover, knn, cap=3).collect()) == {0: [1, 0, 2, 5], 2: [3, 4, 7, 6]}


def test_first_cluster_holds_one_more(spark):
    chain = {i: [i + 1] if i < 5 else [] for i in range(6)}
    assert clusters(O.greedy_cover(table(spark, chain), cap=2).collect()) == {0: [0, 1, 2], 1: [3, 4], 2: [5]}


@pytest.mark.parametrize("seed", range(3))
def test_components_give_the_global_walk(spark, seed):
    """Many components of random graphs: running them apart changes nothing."""
    rng = random.Random(seed)
    graph = {}
    for base in range(0, 120, 20):
        for i in range(base, base + 20):
            graph[i] = rng.sample([x for x in range(base, base + 20) if x != i], rng.randint(0, 3))
    ids = list(graph)
    name = dict(zip(ids, rng.sample(range(500), len(ids))))
    graph = {name[i]: [name[j] for j in nn] for i, nn in graph.items()}
    assert clusters(O.greedy_cover(table(spark, graph), cap=4).collect()) == walk(graph, 4)


def test_steps_and_bad_neighbours(spark):
    graph = {0: [0, -1, 9, 1], 1: [0], 2: []}
    rows = O.greedy_cover(table(spark, graph), cap=5).collect()
    assert clusters(rows) == {0: [0, 1], 1: [2]} and sorted(r.step for r in rows) == [0, 1, 2]


def test_merge_without_foreign_neighbours_stays(spark):
    graph = {0: [1], 1: [0], 2: []}
    knn = table(spark, graph)
    assert clusters(O.merge_short(O.greedy_cover(knn, cap=5), knn, cap=5).collect()) == {0: [0, 1], 1: [2]}


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 30).flatmap(lambda n: st.lists(st.lists(st.integers(0, n - 1), max_size=4), min_size=n, max_size=n)), st.integers(1, 5))
def test_walk_and_merge_properties(lists, cap):
    """The kernels alone: a permutation, bounded sizes, and a permutation again."""
    graph = {i: [x for x in dict.fromkeys(nn) if x != i] for i, nn in enumerate(lists)}
    rows = O._walk(sorted(graph), graph, cap, 0)
    got = {}
    for seed, _, d in rows:
        got.setdefault(seed, []).append(d)
    assert sorted(d for ds in got.values() for d in ds) == list(graph)
    assert all(len(ds) <= cap + (s == 0) for s, ds in got.items())
    assert list(got.values()) == list(walk(graph, cap).values())
    assert all(b in graph[a] for ds in got.values() for a, b in zip(ds, ds[1:]))
    merged = O._merge({k: list(v) for k, v in enumerate(got.values())}, graph, cap)
    assert sorted(d for ds in merged.values() for d in ds) == list(graph)


def vectors(spark, m, groups=None):
    rows = [(i, [float(x) for x in v], int(groups[i]) if groups is not None else 0) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("block_values", [40, 1 << 20])
def test_exact_knn_in_blocks(spark, metric, block_values):
    rng = np.random.default_rng(3)
    m = rng.integers(-3, 4, (40, 4)).astype(np.float32)  # many ties
    g = rng.integers(0, 4, 40)
    v = vectors(spark, m, g)
    for group in (None, "label"):
        out = K.exact_knn(v, v, 5, metric=metric, group_col=group, block_values=block_values).collect()
        got = {(r.q, r["rank"]): (r.n, r.score) for r in out}
        for q in range(40):
            s = m @ m[q] if metric == "ip" else ((m - m[q]) ** 2).sum(1)
            order = sorted((-(s[n]) if metric == "ip" else s[n], n) for n in range(40) if n != q and (group is None or g[n] != g[q]))[:5]
            assert [got[q, k + 1] for k in range(5)] == [(n, float(s[n])) for _, n in order]


def test_inner_product_golden(spark):
    index = vectors(spark, [[1.0] * 8, [2.0] * 8])
    asked = vectors(spark, [[1.0] * 8, [-1.0] * 8])
    out = K.exact_knn(asked, index, 1, same_id=False).collect()
    assert {r.q: r.n for r in out} == {0: 1, 1: 0}


def test_inverted_file_recall(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = v.where("vec_id % 100 = 0")
    assert K.recall(K.ivf_knn(asked, v, 10), K.exact_knn(asked, v, 10)).first().recall >= 0.9
    one = K.ivf_knn(asked, v, 10, most=16)
    assert K.recall(one, K.exact_knn(asked, v, 10)).first().recall >= 0.9


def test_cell_rule():
    assert [K.cell_count(n) for n in (0, 100, 999_999, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000)] == [0, 80, 7999, 1_048_576, 65_536, 1_048_576, 262_144, 1_048_576]
    assert K.training_rows(100) == 100


def test_reference_neighbours(spark):
    knn = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3)], "q long, rank int, n long")
    same = spark.createDataFrame([(0, 7), (1, 7), (2, 8), (3, 9)], "id long, doc long")
    assert [(r["rank"], r.n) for r in K.reference_knn(knn, 1, same).collect()] == [(1, 2)]


def test_quantiles_are_exclusive(spark):
    import statistics

    data = [5, 1, 9, 9, 3, 4, 22, 21, 20, 7]
    df = spark.createDataFrame(list(enumerate(data)), "cluster_id long, n long")
    want = statistics.quantiles(data, n=100)
    assert {r.cut: r.value for r in S.exclusive_quantiles(df, [1, 26, 51, 76, 99]).collect()} == {c: round(want[c - 1], 6) for c in (1, 26, 51, 76, 99)}


def test_slices_without_rest_and_few_rows(spark):
    df = spark.range(10).select(F.col("id").alias("out_pos"))
    assert sorted(r.slice for r in O.slices(df, 3).collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    assert sorted(r.slice for r in O.slices(df, 32).collect()) == list(range(10))
