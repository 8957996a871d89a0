"""The walk and the merge over neighbour lists in arrays: the same clusters in less memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from loomwalk.operators import order as O


def test_lists_are_those_of_a_dictionary():
    rng = random.Random(1)
    ids = rng.sample(range(10**12), 200)
    graph = {i: rng.sample(ids, rng.randint(0, 5)) for i in ids}
    lists = O._Lists(np.array(ids, np.int64), pa.chunked_array([pa.array([graph[i] for i in ids[:70]], pa.list_(pa.int64())), pa.array([graph[i] for i in ids[70:]], pa.list_(pa.int64()))]))
    assert all(list(lists.get(i)) == graph[i] for i in ids) and lists.get(-1) == () and lists.get(10**13) == ()
    rows = O._walk(sorted(ids), lists, 4, min(ids))
    assert rows == O._walk(sorted(ids), graph, 4, min(ids))
    clusters = {}
    for seed, _, d in rows:
        clusters.setdefault(seed, []).append(d)
    assert O._merge({c: list(ds) for c, ds in clusters.items()}, lists, 4) == O._merge(clusters, graph, 4)


def test_memory_of_a_component():
    n, rng = 20_000, np.random.default_rng(2)
    ids = rng.permutation(10 * n)[:n].astype(np.int64)
    nn = pa.ListArray.from_arrays(pa.array(np.arange(0, 9 * n + 1, 9, dtype=np.int32)), pa.array(rng.choice(ids, 9 * n)))
    tracemalloc.start()
    lists = O._Lists(ids, nn)
    rows = O._walk(lists.ids.tolist(), lists, 21, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == n and peak < 300 * n  # with Python's lists about 700 bytes for each document
