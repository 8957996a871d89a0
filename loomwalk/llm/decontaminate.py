"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, utf8
from .words import ALNUM_BYTES, combine, hash_spans, split_words, words_of, LOWER

WINDOW = 10
#: Text of the benchmark that one search table holds; a larger benchmark is searched for in several passes.
TABLE_BYTES = 16 << 20
_SHIFT_BITS = 20
_LANE = 2048


class WuManber:
    """The patterns of one length, in words: shift table over blocks of two words, buckets by the hash of the suffix block."""

    def __init__(self, size: int, patterns: dict[bytes, set[int]], hashes: dict[bytes, np.ndarray]):
        self.size, self.block = size, min(2, size)
        self.shift = np.full(1 << _SHIFT_BITS, size - self.block + 1, np.uint8)
        self.buckets: dict[int, list[tuple[int, bytes, frozenset[int]]]] = {}
        for text, items in patterns.items():
            h = hashes[text]
            blocks = combine(h, self.block)
            at = (blocks & np.uint64((1 << _SHIFT_BITS) - 1)).astype(np.int64)
            np.minimum.at(self.shift, at, (len(blocks) - 1 - np.arange(len(blocks))).astype(np.uint8))
            self.buckets.setdefault(int(blocks[-1]), []).append((int(h[0]), text, frozenset(items)))

    def candidates(self, blocks: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Positions of suffix blocks with shift 0.  Lanes [start, stop) of block positions advance together by their shifts."""
        shift = self.shift[(blocks & np.uint64((1 << _SHIFT_BITS) - 1)).astype(np.int64)] if len(starts) * 4 > len(blocks) else None
        pos, stop, found = starts.copy(), stops, []
        while len(pos):
            s = shift[pos] if shift is not None else self.shift[(blocks[pos] & np.uint64((1 << _SHIFT_BITS) - 1)).astype(np.int64)]
            found.append(pos[s == 0])
            pos = pos + np.maximum(s, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def build(items: list[tuple[int, str]], window: int) -> list[WuManber]:
    """Search tables, one for each pattern length: windows of ``window`` words, or whole items of fewer words."""
    by_size: dict[int, dict[bytes, set[int]]] = {}
    hashes: dict[bytes, np.ndarray] = {}
    for item, text in items:
        low, s, e, h = words_of((text or "").encode(), ALNUM_BYTES)
        n = min(window, len(s))
        for k in range(len(s) - n + 1) if n else ():
            key = b" ".join(low[a:b].tobytes() for a, b in zip(s[k : k + n], e[k : k + n]))
            by_size.setdefault(n, {}).setdefault(key, set()).add(item)
            hashes[key] = h[k : k + n]
    return [WuManber(n, p, hashes) for n, p in sorted(by_size.items())]


def search(tables: list[WuManber], texts: pa.Array) -> list[tuple[int, np.ndarray, set[int]]]:
    """For each text: number of words, sorted positions of hit words, items with an occurring window."""
    body, off = utf8(texts)
    low = LOWER[np.frombuffer(body, np.uint8)]
    # A space between texts keeps their words apart: texts are laid out with one byte between them.
    n = len(off) - 1
    wide = np.full(len(low) + n, 0x20, np.uint8)
    wide[np.arange(len(low)) + np.repeat(np.arange(n), np.diff(off))] = low
    off = off + np.arange(n + 1)
    s, e = split_words(wide, ALNUM_BYTES)
    h = hash_spans(wide, s, e)
    first = np.searchsorted(s, off)
    counts = np.diff(first)
    hits: list[list[np.ndarray]] = [[] for _ in range(n)]
    items: list[set[int]] = [set() for _ in range(n)]
    for t in tables:
        blocks = combine(h, t.block)
        lo, hi = first[:-1] + t.size - t.block, first[1:] - t.block + 1  # suffix blocks of windows that lie in one text
        ok = hi > lo
        lo, hi, doc = lo[ok], hi[ok], np.flatnonzero(ok)
        k = (hi - lo + _LANE - 1) // _LANE  # long texts are cut into lanes
        lane_lo = np.repeat(lo, k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)) * _LANE
        lane_hi = np.minimum(lane_lo + _LANE, np.repeat(hi, k))
        for p in np.unique(t.candidates(blocks, lane_lo, lane_hi)):
            bucket = t.buckets.get(int(blocks[p]))
            if bucket is None:
                continue
            a = p + t.block - t.size
            head = int(h[a])
            for prefix, text, found in bucket:
                if prefix == head and text == b" ".join(wide[x:y].tobytes() for x, y in zip(s[a : a + t.size], e[a : a + t.size])):
                    d = int(np.searchsorted(first, a, "right")) - 1
                    hits[d].append(np.arange(a - first[d], a - first[d] + t.size))
                    items[d] |= found
    return [(int(c), np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64), i) for c, x, i in zip(counts, hits, items)]


FIELDS = [("n_words", T.LongType()), ("hit_words", T.ArrayType(T.LongType(), False)), ("item_ids", T.ArrayType(T.LongType(), False))]


def find_windows(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with (n_words, hit_words, item_ids): the words inside any occurrence of a window of a benchmark item.

    Words are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing A-Z.  A window is ``window``
    consecutive words of an item; an item of fewer words, but not none, is one window.  ``hit_words`` are sorted 0-based word
    positions, ``item_ids`` the sorted ids of items with an occurring window.  Null and empty texts have no words; null
    and wordless items no windows; a null item id counts as -1.  Repeated rows and items do no harm; other columns of ``docs`` pass through.  An empty
    benchmark hits nothing.

    The benchmark is the stated query set.  Its size is checked; it is cut into blocks of at most ``table_bytes`` of text, and
    each block is one narrow pass over the documents, with no shuffle.
    """
    src = benchmark.select(F.coalesce(F.col(item_col).cast("long"), F.lit(-1)).alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    size = src.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = max(1, -(-size // table_bytes))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<bigint>"), "item_ids": F.array().cast("array<bigint>")})
    for b in range(blocks):
        part = src if blocks == 1 else src.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        shared = docs.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in part.toLocalIterator()])
        new = [("__words", T.LongType()), ("__hit", T.ArrayType(T.LongType(), False)), ("__items", T.ArrayType(T.LongType(), False))]
        out = append_columns(out, text_col, new, _searcher(shared, window))
        both = lambda a, c: F.array_sort(F.array_union(a, c)) if blocks > 1 else F.col(c)
        out = out.withColumns({"n_words": F.col("__words"), "hit_words": both("hit_words", "__hit"), "item_ids": both("item_ids", "__items")}).drop("__words", "__hit", "__items")
    return out


def _searcher(shared, window: int) -> Callable:
    def make():
        tables = build(shared.value, window)

        def run(texts: pa.Array) -> list[pa.Array]:
            rows = search(tables, texts)
            kind = pa.list_(pa.int64())
            return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tolist() for r in rows], kind), pa.array([sorted(r[2]) for r in rows], kind)]

        return run

    return make


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = find_windows(docs.select("doc_id", "text"), benchmark)
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The documents without a hit word, with the columns of ``docs`` whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    return find_windows(packed, benchmark, text_col="__text", **how).where(F.size("hit_words") == 0).select("__row.*")
