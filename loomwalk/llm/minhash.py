"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, cut, flag_in, maybe_in, utf8
from .linkage import link_buckets, shared_buckets
from .words import mix, shingle_set

SHINGLE = 5
#: 28 bands of 7 coordinates: a pair at Jaccard 0.85 shares no band with probability 2e-5.
BANDS, ROWS = 28, 7
_DOMAIN_BITS = 20


@lru_cache(maxsize=2)
def _permutation(k: int) -> np.ndarray:
    """The second permutation of the domain, with its first k values repeated at the end: every shift is a slice."""
    p = np.random.Generator(np.random.PCG64(7)).permutation(1 << _DOMAIN_BITS).astype(np.uint32)
    return np.concatenate([p, p[:k]])


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """k MinHash coordinates.  The first permutation places a shingle at a position of the domain; coordinate j is the least value, over
    the shingles, of the second permutation shifted circularly by j.  One shingle's k values are k neighbours in memory."""
    table = np.lib.stride_tricks.sliding_window_view(_permutation(k), k)
    at = np.unique((mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _DOMAIN_BITS)).astype(np.int64))
    out = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 512):
        np.minimum(out, table[at[i : i + 512]].min(axis=0), out=out)
    return out


def _digest(hashes: np.ndarray) -> bytes:
    """A 128-bit digest of a set."""
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _profile(bands: int, rows: int, shingle: int):
    def make():
        seen: dict[bytes, np.ndarray] = {}
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def keys(s: np.ndarray, node: bytes) -> np.ndarray:
            if node not in seen:
                if len(seen) > 4096:
                    seen.clear()
                sig = signature(s, bands * rows).reshape(bands, rows)
                out = salt.copy()
                for j in range(rows):
                    out = mix(out + sig[:, j].astype(np.uint64))
                seen[node] = out.view(np.int64)
            return seen[node]

        def run(texts: pa.Array) -> list[pa.Array]:
            body, off = utf8(texts)
            sets = [shingle_set(body[a:b], shingle) for a, b in zip(off[:-1], off[1:])]
            nodes = [_digest(s) if len(s) else None for s in sets]
            with np.errstate(over="ignore"):
                bandkeys = [keys(s, n) if n is not None else [] for s, n in zip(sets, nodes)]
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(bandkeys, pa.list_(pa.int64()))]

        return run

    return make


def _sets(shingle: int):
    def make():
        def run(texts: pa.Array) -> list[pa.Array]:
            body, off = utf8(texts)
            sets = [shingle_set(body[a:b], shingle) for a, b in zip(off[:-1], off[1:])]
            return [pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]

        return run

    return make


#: Shingles (with a floor for each document) in one side of a block of a large bucket.
BLOCK_SHINGLES = 1 << 20


def _spanning_links(offsets: np.ndarray, values: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets ``values[offsets[i]:offsets[i + 1]]`` whose Jaccard similarity is high enough, at most one per set."""
    m, sizes = len(offsets) - 1, np.diff(offsets)
    _, ident, count = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = count[ident] > 1
    ident, owner = ident[shared], owner[shared]
    order = np.argsort(ident, kind="stable")
    posting, first = owner[order], np.searchsorted(ident[order], np.arange(len(count) + 1))
    mine = np.searchsorted(owner, np.arange(m + 1))
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(m - 1):
        s = ident[mine[i] : mine[i + 1]]
        n = first[s + 1] - first[s]
        if not len(n):
            continue
        at = np.repeat(first[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=m)[i + 1 :]
        for j in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[i + 1 :] - both)) + i + 1:
            a, b = find(i), find(int(j))
            if a != b:
                root[b] = a
                out.append((i, int(j)))
    return out


def _linked_in_blocks(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside large buckets (bucket, node): members are dealt into blocks of bounded size, each pair of blocks is one
    group, and a group answers with a spanning forest of its links.  All pairs are compared, none is a row."""
    members = live.join(sets.select("node", "n", "hashes"), "node")
    blocks = members.groupBy("bucket").agg(F.ceil(F.sum(F.col("n") + 1024) / BLOCK_SHINGLES).cast("int").alias("k"))
    placed = members.join(blocks, "bucket").withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "node", "hashes")

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        hashes = pa.concat_arrays(table.column("hashes").chunks)
        offsets = hashes.offsets.to_numpy()
        links = _spanning_links(offsets - offsets[0], hashes.flatten().to_numpy(), percent)
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.binary()), "b": pa.array([nodes[j] for _, j in links], pa.binary())})

    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(run, "a binary, b binary")


def _grouped(docs: DataFrame, *, percent: int, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: (doc_id, mark, n, node, component_id, leader).

    ``mark`` is a hash of the text, ``node`` a digest of the shingle set, null without shingles; ``component_id`` is the smallest id of the set's component and
    ``leader`` the least set that has it."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    fields = [("n", T.LongType()), ("node", T.BinaryType()), ("bands", T.ArrayType(T.LongType(), False))]
    marked = src.withColumn("mark", F.xxhash64("text"))
    profile = cut(append_columns(marked, "text", fields, _profile(bands, rows, shingle), keep=["doc_id", "mark"]), "minhash-profile")
    # array<long> is not orderable by hash aggregation but first() of equal values is: equal sets have equal bands.
    classes = cut(profile.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "minhash-classes")
    buckets = classes.select("node", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node")
    buckets = shared_buckets(buckets, "minhash-buckets")
    wanted = buckets.select("node").dropDuplicates().join(classes.select("node", "rep", "n"), "node")
    wanted = cut(wanted.withColumn("rep", F.coalesce("rep", F.lit(-1))), "minhash-wanted")
    keyed = src.withColumn("rep", F.coalesce("doc_id", F.lit(-1)))
    near = maybe_in(keyed, F.col("rep"), wanted, F.col("rep"))
    found = append_columns(near, "text", [("node", T.BinaryType()), ("hashes", T.ArrayType(T.LongType(), False))], _sets(shingle), keep=["rep"])
    sets = found.join(wanted, ["node", "rep"]).groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("n").alias("n"))
    sets = cut(sets, "minhash-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"))
        full = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("both", F.size(F.array_intersect("ha", "hb")))
        return full.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")

    def finish(live: DataFrame) -> DataFrame:
        return _linked_in_blocks(live, sets, percent)

    live = cut(buckets.join(wanted.select("node", F.col("n").alias("about")), "node"), "minhash-live")
    _, comp = link_buckets(live, lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y), verify, finish)
    named = classes.select("node", "rep").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("l"))
    named = named.join(least, "component").select("node", F.col("l.rep").alias("component_id"), F.col("l.node").alias("leader"))
    # A common class is a common join key: only its id travels, and skewed keys are split at run time.
    return profile.select("doc_id", "mark", "n", "node").join(named, "node", "left")


def near_duplicates(docs: DataFrame, *, percent: int = 85, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept).

    A-Z are lower-cased, words are runs without ASCII white space; a document's set is its distinct ``shingle``-word runs, or its whole
    sequence if it has fewer words.  Documents are linked when 100 * intersection >= percent * union on full sets, of 64-bit hashes of the runs; ``component_id`` is
    the smallest id reachable, ``kept`` whether that is the document's own.  A document without words (null, empty, only white space) has
    no shingles and stays alone.  Rows that repeat an id are documents of their own, so an id may come with several components; a null id is
    never smaller than another one; other ids are whole numbers.  Other columns are ignored; an empty table gives no rows.

    Documents with equal sets are one class (a 128-bit digest of the set).  Class representatives go into band buckets; buckets become
    groups by :func:`~.linkage.link_buckets`.  Texts are read twice and never shuffled: what moves are digests, band keys, and the shingle sets of
    representatives that share a bucket with another one.
    """
    out = _grouped(docs, percent=percent, shingle=shingle, bands=bands, rows=rows, id_col=id_col, text_col=text_col)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, percent: int = 85, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each component the smallest id stays, of rows with that id those of one shingle set; documents without words stay.

    Rows that repeat an id are told apart by a hash of their text; rows equal in both share their fate.  The columns are those of
    ``docs``, whatever their names.  Texts of documents that may go move once."""
    out = _grouped(docs, percent=percent, shingle=shingle, bands=bands, rows=rows, id_col=id_col, text_col=text_col)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("node") == F.col("leader"))
    gone = cut(out.where("n > 0").where(~stays).select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__gone_mark")).dropDuplicates(), "minhash-gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").cast("long").alias("__id"), F.xxhash64(F.col(f"`{text_col}`")).alias("__mark"))
    flagged = flag_in(packed, F.xxhash64("__id", "__mark"), gone, F.xxhash64("__gone", "__gone_mark"))
    same = F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__mark") == F.col("__gone_mark"))
    left = flagged.where("__maybe").join(gone, same, "left_anti").select("__row.*")
    return flagged.where("not __maybe").select("__row.*").unionByName(left)
