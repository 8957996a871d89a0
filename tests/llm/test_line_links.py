"""Crowded buckets of lines: a line needs one link to a component, not one to each line of it."""

from pyspark.sql import functions as F

from loomwalk.llm import line_dedup as L

from .helpers import documents

LONG = "international recommendations concerning environmental administrations of the neighbouring municipalities were published yesterday by"


def test_one_link_to_a_component(spark, monkeypatch):
    """Thirty lines that differ in a short word, one of them not yet in the component of the others."""
    found = []

    def link_buckets(live, alike, verify, finish, most):
        nodes = sorted(r.node for r in live.select("node").distinct().collect())
        apart = F.col("node") == F.lit(bytes(nodes[0]))
        tagged = live.withColumn("component", F.when(apart, F.col("node")).otherwise(F.lit(bytes(nodes[1]))))
        found.append((len(nodes), [(bytes(r.a), bytes(r.b)) for r in finish(tagged).collect()], nodes))
        return None, live.select("node", F.col("node").alias("component")).limit(0)

    monkeypatch.setattr(L, "link_buckets", link_buckets)
    L.repeated_lines(documents(spark, [(i, f"{LONG} k{i}") for i in range(30)]))
    [(n, links, nodes)] = found
    assert n == 30 and len(links) == 1
    assert links[0][0] == nodes[0] and links[0][1] in nodes[1:]


def test_links_to_several_components_stay(spark, monkeypatch):
    """Every line in a component of its own: each pair is one link, as none of them follows from another."""
    found = []

    def link_buckets(live, alike, verify, finish, most):
        found.extend(frozenset((bytes(r.a), bytes(r.b))) for r in finish(live.withColumn("component", F.col("node"))).collect())
        return None, live.select("node", F.col("node").alias("component")).limit(0)

    monkeypatch.setattr(L, "link_buckets", link_buckets)
    L.repeated_lines(documents(spark, [(i, f"{LONG} k{i}") for i in range(12)]))
    assert len(set(found)) == 12 * 11 // 2
