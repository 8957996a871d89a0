"""Ordering a corpus: a greedy path cover of the neighbour graph, merging of short clusters, the flat order and its slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, numbered

#: Documents in a cluster; the first cluster holds one more.
CAP = 21
NEIGHBOURS = 9


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), by rounds of taking the least label around, with jumps."""
    both = links.where("a <> b").select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropDuplicates()
    edges = cut(both, "order-edges")
    label = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("node"), "c"), "order-labels")
    while True:
        around = edges.join(label.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("cb"))
        seen = label.join(around, label.node == around.a).select("node", F.least("c", "cb").alias("new"), F.col("c").alias("old"))
        jump = seen.join(label.select(F.col("node").alias("new"), F.col("c").alias("far")), "new", "left")
        step = cut(jump.select("node", F.coalesce(F.least("new", "far"), F.col("new")).alias("c"), "old"), "order-labels")
        label = step.select("node", "c")
        if step.where("c <> old").isEmpty():
            return label.withColumnRenamed("c", "component")


def _links(knn: DataFrame) -> DataFrame:
    return knn.select(F.col("q").alias("a"), F.explode("nn").alias("b"))


def _with_component(knn: DataFrame) -> DataFrame:
    label = components(_links(knn))
    return knn.join(label.withColumnRenamed("node", "q"), "q", "left").withColumn("component", F.coalesce("component", "q"))


class _Lists:
    """Neighbour lists by id in two arrays: some ten bytes for a neighbour, where Python's lists and numbers take forty."""

    def __init__(self, ids: np.ndarray, lists: pa.ChunkedArray):
        order = np.argsort(ids, kind="stable")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        lists = lists.take(pa.array(order))
        self.ids, self.n = ids[order], lists.flatten().to_numpy()
        self.at = np.append(0, np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy()))

    def get(self, key: int, default: tuple = ()) -> list[int] | tuple:
        i = int(np.searchsorted(self.ids, key))
        return self.n[self.at[i] : self.at[i + 1]].tolist() if i < len(self.ids) and self.ids[i] == key else default


def _walk(ids: list[int], nn: dict[int, list[int]], cap: int, first: int | None) -> list[tuple[int, int, int]]:
    """(seed, place in its cluster, id) of the greedy cover of one component; ``first`` is the smallest id of all components."""
    seen: set[int] = set()
    out = []
    for seed in ids:
        if seed in seen:
            continue
        at, place, most = seed, 0, cap + 1 if seed == first else cap
        while True:
            seen.add(at)
            out.append((seed, place, at))
            place += 1
            step = next((x for x in nn.get(at, ()) if x not in seen), None) if place < most else None
            if step is None:
                break
            at = step
    return out


def greedy_cover(knn: DataFrame, *, cap: int = CAP) -> DataFrame:
    """(doc_id, seed, pos, cluster_id, step) of the greedy path cover of the graph ``knn`` (q, nn: neighbours by rank).

    A cluster begins at the smallest id not yet visited and goes on to the first neighbour not yet visited, until there is none or it holds
    ``cap`` documents; the very first one may hold one more.  Negative, null and own ids are no neighbours.  Neighbours which are no ``q``
    themselves are not visited.

    Every cluster begins at the smallest unvisited id and its path never leaves a connected component.  So components do not touch each
    other, and running them apart gives just the clusters of one global walk, which then are numbered by their seeds.  One component's
    walk is sequential; its task holds ids only, some 200 to 300 bytes for each document and eight for each neighbour.
    """
    ids = knn.select(F.col("q").alias("n"))
    flat = knn.select("q", F.posexplode("nn").alias("r", "n")).where("n >= 0 and n <> q").join(ids, "n", "left_semi")
    lists = flat.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("x")).select("q", F.col("x.n").alias("nn"))
    graph = knn.select("q").join(lists, "q", "left").withColumn("nn", F.coalesce("nn", F.array().cast("array<long>")))
    graph = _with_component(cut(graph, "cover-graph"))
    low = graph.agg(F.min("q")).first()[0]

    def walk(table: pa.Table) -> pa.Table:
        lists = _Lists(table["q"].to_numpy(), table["nn"])
        rows = _walk(lists.ids.tolist(), lists, cap, low)
        return pa.table(dict(zip(("seed", "pos", "doc_id"), np.array(rows, np.int64).T)))

    steps = cut(graph.groupBy("component").applyInArrow(walk, "seed long, pos long, doc_id long"), "cover-steps")
    clusters = numbered(steps.where("pos = 0").select("seed"), "seed", out="cluster_id")
    placed = numbered(steps.join(clusters, "seed"), "seed", "pos", out="step")
    return placed.select("doc_id", "seed", F.col("pos").cast("int").alias("pos"), F.col("cluster_id").cast("int").alias("cluster_id"), F.col("step").cast("int").alias("step"))


def _merge(clusters: dict[int, list[int]], nn: dict[int, list[int]], cap: int) -> dict[int, list[int]]:
    of = {d: c for c, ds in clusters.items() for d in ds}
    for c in sorted(clusters):
        if len(clusters[c]) >= cap:
            continue
        stay = []
        for d in list(clusters[c]):
            to = next((n for n in nn.get(d, ()) if n in of and of[n] != c), None)
            if to is None:
                stay.append(d)
                continue
            target = clusters[of[to]]
            target.insert(target.index(to), d)
            of[d] = of[to]
        clusters[c] = stay
    return {c: ds for c, ds in clusters.items() if ds}


def merge_short(cover: DataFrame, knn: DataFrame, *, cap: int = CAP) -> DataFrame:
    """(cluster_id, pos, doc_id) after the documents of clusters with fewer than ``cap`` have moved in front of their nearest neighbour elsewhere.

    Clusters are taken in the order of their ids and are as long as they are by then.  A document without a neighbour in another
    cluster stays.  Links never leave a component, so components are merged apart; a task holds one component's ids.
    """
    graph = _with_component(cut(knn.select("q", F.filter("nn", lambda x: x >= 0).alias("nn")), "merge-graph"))
    rows = cover.join(graph.withColumnRenamed("q", "doc_id"), "doc_id")

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster_id", "ascending"), ("pos", "ascending")])
        clusters: dict[int, list[int]] = {}
        ids = table["doc_id"].to_pylist()
        for c, d in zip(table["cluster_id"].to_pylist(), ids):
            clusters.setdefault(c, []).append(d)
        out = [(c, i, d) for c, ds in _merge(clusters, _Lists(np.array(ids, np.int64), table["nn"]), cap).items() for i, d in enumerate(ds)]
        return pa.table({n: np.array(x, k) for n, x, k in zip(("cluster_id", "pos", "doc_id"), zip(*out), (np.int32, np.int32, np.int64))})

    small = rows.select("component", "cluster_id", "pos", "doc_id", "nn")
    return small.groupBy("component").applyInArrow(merge, "cluster_id int, pos int, doc_id long")


def flatten(clusters: DataFrame) -> DataFrame:
    """(out_pos, doc_id, cluster_id, pos) in the order of the clusters."""
    return numbered(clusters, "cluster_id", "pos", out="out_pos").select("out_pos", "doc_id", "cluster_id", "pos")


def diverse_order(clusters: DataFrame) -> DataFrame:
    """(out_pos, doc_id): whole clusters in the order of a hash of their ids, so that adjacent contexts differ."""
    key = clusters.withColumn("key", F.md5(F.col("cluster_id").cast("string")))
    return numbered(key, "key", "cluster_id", "pos", out="out_pos").select("out_pos", "doc_id")


def slices(ordered: DataFrame, parts: int, *, pos_col: str = "out_pos") -> DataFrame:
    """``ordered`` with ``slice``: contiguous slices of ``max(1, n // parts)`` rows, so there may be one more than ``parts``."""
    n = ordered.count()
    return ordered.withColumn("slice", F.floor(F.col(pos_col) / max(1, n // parts)).cast("long"))
