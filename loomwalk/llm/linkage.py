"""Connected groups from buckets of candidates, without emitting all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, maybe_in

#: Ranks of the members of a bucket that lead it, round by round: up to the 1st, the 3rd, the 9th, then three times more each round.  Few at a time, as most of a
#: bucket of near copies is one component by then, and pairs inside it are not compared.
LEADERS = (1, 3, 9)


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of edges apart: their number, and 128 bits over all of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each halves distances at least, so chains take a logarithmic number of
    rounds, and no node ever gathers its neighbours in one row.  Rounds are cut to the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).dropDuplicates(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.where("u <> v").groupBy("u").agg(F.min("v").alias("m"))
        linked = large.where("u <> v").join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").dropDuplicates(), "edges")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).dropDuplicates())


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, component) after further links (a, b): only the components that they touch are grouped again."""
    of = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = cut(components(named), "merged")
    old = comp.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    new = merged.join(comp.select("node"), "node", "left_anti")
    return cut(old.unionByName(new), "components")


def shared_buckets(buckets: DataFrame, name: str = "buckets") -> DataFrame:
    """Of distinct rows (bucket: a long, node), those whose bucket has several nodes, with c: how many; written out.

    Buckets are counted without the nodes; a bitmap of the shared ones then keeps most other rows from being shuffled."""
    shared = cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), f"{name}-shared")
    return cut(maybe_in(buckets, F.col("bucket"), shared, F.col("bucket")).join(shared, "bucket").select("bucket", "node", "c"), name)


def link_buckets(live: DataFrame, alike: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame] | None = None, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """(links, components) of the nodes that share a bucket and pass ``alike`` and ``verify``.

    ``live``: what :func:`shared_buckets` makes, with a column ``about`` of a few bytes for each node.  ``alike`` tells from two of these whether
    the nodes may be linked; it is a condition of the join, so pairs that fail it are no rows.  ``verify`` takes candidate pairs (a, b) and returns those that are linked.
    The smallest node of each bucket leads it.  At first each node is compared with the smallest of its leaders; then, round by round, leaders with the members of
    other components.  A bucket whose members lie in one component is done: further links inside it would change nothing.  In what is left, the next members lead, and are
    compared with the later members, until no bucket is left or all members have led.  So no link
    that would join two components is lost, a bucket of near copies costs one pair per member, and nothing is capped.

    ``finish`` may take over the unfinished buckets of more than ``most`` members after the first round, as rows (bucket, node, about, component, c); it
    returns links (a, b) that connect what is linked inside each bucket, without a row per pair.
    """
    may = alike(F.col("about"), F.col("about_a"))
    lead = live.groupBy("bucket").agg(F.min(F.struct("node", "about")).alias("l")).select("bucket", F.col("l.node").alias("a"), F.col("l.about").alias("about_a"))
    pairs = live.join(lead, "bucket").where("node <> a").where(may).groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a"))
    links = cut(verify(pairs).select("a", "b"), "links")
    comp = cut(components(links), "components")
    low, high, k = 0, 1, 0
    while True:
        tagged = live.where(F.col("c") > low).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        h = F.xxhash64("component")
        apart = tagged.groupBy("bucket").agg(F.min(h).alias("x"), F.max(h).alias("y")).where("x <> y").select("bucket")
        live = cut(tagged.join(apart, "bucket", "left_semi"), "live")
        if live.isEmpty():
            return links, comp
        more = None
        if finish is not None and low == 1:
            more = finish(live.where(F.col("c") > most)).select("a", "b")
            live = live.where(F.col("c") <= most)
        rank = F.row_number().over(W.partitionBy("bucket").orderBy("node"))
        lead = live.select("bucket", "node", "about", "component", rank.alias("r")).where(F.col("r") <= high).where(F.col("r") > low)
        lead = lead.select("bucket", F.col("node").alias("a"), F.col("about").alias("about_a"), F.col("component").alias("ca"))
        pairs = lead.join(live, "bucket").where("node > a and ca <> component").where(may).select("a", F.col("node").alias("b")).dropDuplicates()
        found = verify(pairs).select("a", "b")
        new = cut(found if more is None else found.unionByName(more), "links")
        live, k = live.select("bucket", "node", "about", "c"), k + 1
        low, high = high, LEADERS[k] if k < len(LEADERS) else high * 3
        if not new.isEmpty():
            links, comp = links.unionByName(new), joined(comp, new)
