"""Language-model scores: a hierarchical Pitman-Yor model over word bigrams, seated by Gibbs sampling.

Restaurants: one for each context word, whose tables are the customers of the one root restaurant that all share; the root's base
measure gives each known word the same probability and unknown words the rest.  Seatings are sampled, and a word's probability
after its context is the average, over the kept samples, of the predictive probability.

How it is spread out.  Documents are read in slices of bounded size.  What moves are messages, one for each slice and partition, each an
Arrow row with packed arrays.  Words are dealt out by their hash and pairs by the hash of both ids, so a common word is an
entry of a slice's message, not a row for each occurrence, and the pairs of a common context lie in all partitions.

1. scan: slice -> words with their training counts -> partition of the word;
2. words: total counts, ids -> slice;
3. slice: pairs with their training counts -> partition of the pair;
4. pairs: Gibbs sampling of each pair's tables -> slice (count and tables of each pair) and -> partitions of both words (sums);
5. words: Gibbs sampling of the root's tables -> slice;
6. slice: probabilities, summed for each document.

While context restaurants are sampled, the root's probabilities are those of the plain counts, and a context's number of tables is estimated from the
pairs in the same partition, which are a random part of its pairs; the root is then sampled from the tables that came out.
The final probabilities use the true sums, so that they add up to one.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, bounded_batches, cut, fresh_path, give_back, utf8
from .token_files import _filesystem
from .words import LOWER, WORD_BYTES, hash_spans, mix

FOLDS, FOLD = 5, 1
#: Strength of the restaurants of contexts, and of the root.
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
#: Sweeps before the first kept sample, and kept samples.
BURN, SAMPLES = 4, 3
#: Numbers of customers up to which the chances of all numbers of tables come from exact tables; larger ones from their scaling limit.
EXACT = 1024
#: Burning goes on until the logarithm of the weights, averaged over customers, moves by no more than this in a sweep.
SETTLED = 0.002
#: Bytes of text in one slice; a longer text is a slice of its own.
SLICE = 16 << 20

#: Tables for ``bytes.translate``, which needs no index of eight bytes for each byte.
_LOWER, _IN_WORD = LOWER.tobytes(), WORD_BYTES.tobytes()
_END, _UNKNOWN, _START = np.uint64(0x1D8AF066B3A2C9E7), 0, 1
_MSG = "to int, kind int, slice long, part int, data binary, stats array<bigint>"
_SLICE_FILE, _WORDS, _IDS, _PAIRS, _TABLES, _SUMS, _ROOT = range(7)


# --- packing ---------------------------------------------------------------------------------------------------
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: unsigned integers in the narrowest type, bytes of equal weight side by side."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        parts.append((a.dtype.str, a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, body in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        d = np.dtype(kind)
        out.append(np.frombuffer(np.frombuffer(body, np.uint8).reshape(d.itemsize, -1).T.tobytes(), d))
    return out


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["to", "kind", "slice", "part", "data", "stats"])


def _deliver(messages: DataFrame, parts: int, work: Callable[[int, dict], Iterator[tuple]]) -> DataFrame:
    """Each partition gets the messages addressed to it, by kind in the order of (slice, part), and answers with messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = defaultdict(list)
        to = None
        for b in batches:
            for t, kind, s, p, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                got[kind].append((s, p, data))
                to = t
        b = data = None
        if to is None:
            return
        for kind in got:
            got[kind].sort(key=lambda x: x[:2])
        out, size = [], 0
        for row in work(to, got):
            out.append(row)
            size += len(row[4] or b"")
            if size > 8 << 20:
                yield _messages(out)
                out, size = [], 0
        yield _messages(out)
        got.clear()
        out = row = None
        give_back()

    return messages.repartitionById(parts, F.col("to")).mapInArrow(run, _MSG)


def _split(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, ends of each key's run)."""
    return np.argsort(keys, kind="stable"), np.cumsum(np.bincount(keys, minlength=parts))


# --- slices ----------------------------------------------------------------------------------------------------
def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts, number of tokens of each text): its words, lower-cased, and one end."""
    body, off = utf8(texts)
    ends = off.tolist()
    wide = b" ".join([*(body[a:b] for a, b in zip(ends, ends[1:])), b""]).translate(_LOWER)  # a space after each text keeps its words apart from the next one's
    off = off + np.arange(len(off))
    edge = np.diff(np.frombuffer(b"\0" + wide.translate(_IN_WORD) + b"\0", np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = hash_spans(np.frombuffer(wide, np.uint8), s, e, 1 << 17)
    first = np.searchsorted(s, off)
    return np.insert(h, first[1:], _END), np.diff(first) + 1


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in their order, where one of each is, of each key its place among them), in about a third of the memory of ``np.unique``."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], order[new], place


def distinct_tokens(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, of each token its place among them, number of tokens of each text), SLICE_BYTES of text at a time."""
    words, places, length = [], [], []
    for t in texts:
        step = max(1, int(len(t) * SLICE_BYTES / max(1, t.nbytes)))
        for i in range(0, len(t), step):
            h, n = tokens_of(t.slice(i, step))
            w, _, place = distinct(h)
            words.append(w)
            places.append(place)
            length.append(n)
    every, _, of = distinct(np.concatenate(words))
    start = 0
    for k, w in enumerate(words):
        places[k] = of[start : start + len(w)][places[k]]
        start += len(w)
    return every, np.concatenate(places), np.concatenate(length)


@dataclass
class Slice:
    doc_id: np.ndarray
    known_id: np.ndarray  # whether the id is not null
    train: np.ndarray
    length: np.ndarray  # tokens of each document
    token: np.ndarray  # of each token, its word's place in the slice; words by falling frequency
    salt: np.ndarray  # of each word, 16 bits of its hash

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the context and of the word of each distinct pair, of each token its pair); the start's place is the last."""
        v = len(self.salt)
        key = np.append(v, self.token[:-1]).astype(np.int64)
        key[np.cumsum(self.length)[:-1]] = v
        key *= v + 1
        key += self.token
        key, _, pair = distinct(key)
        return key // (v + 1), key % (v + 1), pair

    def save(self, uri: str) -> None:
        fs, path = _filesystem(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(pack(self.doc_id.view(np.uint64), self.known_id, self.train, self.length, self.token, self.salt))

    @staticmethod
    def load(uri: str) -> Slice:
        fs, path = _filesystem(uri)
        with fs.open_input_file(path) as f:
            a = unpack(f.read())
        return Slice(a[0].astype(np.uint64).view(np.int64), a[1].astype(bool), a[2].astype(bool), a[3].astype(np.int64), a[4].astype(np.int32), a[5].astype(np.int64))


def _scan(parts: int, folder: str, slice_bytes: int):
    """(1) of the module's plan.  The table that it makes is written out, so that later stages see one set of slices."""

    def one(number: int, home: int, ids: list, train: list, texts: list) -> Iterator[tuple]:
        words, token, length = distinct_tokens(texts)
        texts.clear()
        doc_id = pa.concat_arrays(ids)
        learn = np.concatenate(train)
        order = np.argsort(-np.bincount(token, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words))
        token, words = rank[token], words[order]
        salt = (words >> np.uint64(48)).astype(np.int64)
        uri = f"{folder}/{number}-{uuid.uuid4().hex}"
        Slice(doc_id.fill_null(0).to_numpy(), ~doc_id.is_null().to_numpy(zero_copy_only=False), learn, length, token, salt).save(uri)
        yield (home, _SLICE_FILE, number, 0, uri.encode(), [int(learn.sum())])
        count = np.bincount(token[np.repeat(learn, length)], minlength=len(words))
        by, ends = _split(salt % parts, parts)
        for p in np.unique(salt % parts).tolist():
            mine = by[ends[p - 1] if p else 0 : ends[p]]
            yield (p, _WORDS, number, home, pack(words[mine], count[mine]), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held, size = TaskContext.get().partitionId(), 0, ([], [], []), 0

        def flush() -> pa.RecordBatch:
            out = _messages(list(one(task << 24 | k, (task + k * 7919) % parts, *held)))
            for x in held:
                x.clear()
            give_back()
            return out

        for b in batches:
            step = max(1, int(b.num_rows * slice_bytes / max(1, b.column(2).nbytes)))
            for i in range(0, b.num_rows, step):
                x = b.slice(i, step)
                if size and size + x.column(2).nbytes > slice_bytes:
                    yield flush()
                    size, k = 0, k + 1
                for to, c in zip(held, (x.column(0), x.column(1).to_numpy(zero_copy_only=False), x.column(2))):
                    to.append(c)
                size += x.column(2).nbytes
        if held[0]:
            yield flush()

    return run


# --- words -----------------------------------------------------------------------------------------------------
class _Vocabulary:
    """A partition's words: total counts, and ids by falling count; a word without training tokens is unknown."""

    def __init__(self, part: int, parts: int, got: list):
        asked = [(s, home, *unpack(data)) for s, home, data in got]
        self.asked = [(s, home) for s, home, _, _ in asked]
        self.ends = np.cumsum([0, *(len(w) for _, _, w, _ in asked)])
        words, at = np.unique(np.concatenate([w for _, _, w, _ in asked]).astype(np.uint64), return_inverse=True)
        count = np.bincount(at, np.concatenate([c for _, _, _, c in asked]), len(words)).astype(np.int64)
        order = np.lexsort((words, -count))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.count = count[order][: (count > 0).sum()]
        self.place = np.where(count > 0, place, -1)[at]  # of each word that was asked for
        self.part, self.parts = part, parts

    def answers(self, kind: int, *columns: np.ndarray) -> Iterator[tuple]:
        """To each slice, the columns for the words it asked for; the last value of a column is that of unknown words."""
        for k, (s, home) in enumerate(self.asked):
            mine = self.place[self.ends[k] : self.ends[k + 1]]
            yield (home, kind, s, self.part, pack(*(c[mine] for c in columns)), None)


def _number_words(parts: int):
    """(2): ids and counts to the slices; statistics: training tokens, words, words seen once, twice."""

    def work(part: int, got: dict) -> Iterator[tuple]:
        v = _Vocabulary(part, parts, got[_WORDS])
        ids = np.append(np.arange(len(v.count)) * parts + part + 2, _UNKNOWN)
        rows = v.answers(_IDS, ids, np.append(v.count, 0))
        stats = [int(v.count.sum()), len(v.count), int((v.count == 1).sum()), int((v.count == 2).sum())]
        for k, row in enumerate(rows):
            yield row if k else (*row[:5], stats)

    return work


def _named(file: Slice, got: list, parts: int, columns: int) -> list[np.ndarray]:
    """The answers of all partitions in the order of the slice's words."""
    by, _ = _split(file.salt % parts, parts)
    mine = sorted((p, unpack(data)) for p, data in got)
    out = []
    for k in range(columns):
        a = np.empty(len(by), np.int64)
        a[by] = np.concatenate([x[k] for _, x in mine])
        out.append(a)
    return out


# --- pairs -----------------------------------------------------------------------------------------------------
def _home_of_pair(u: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(mix(u.astype(np.uint64)) + w.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


@dataclass
class _Asked:
    """The pairs of a slice in the order in which they are asked for: those of two known words."""

    pair: np.ndarray  # of each token, its pair
    u: np.ndarray  # of each pair, the places of its words in the slice
    w: np.ndarray
    order: np.ndarray  # pairs that are asked for
    ends: np.ndarray
    ids: np.ndarray
    count: np.ndarray


def _ask(file: Slice, got: list, parts: int, documents: int) -> _Asked:
    ids, count = _named(file, got, parts, 2)
    ids, count = np.append(ids, _START), np.append(count, documents)
    u, w, pair = file.pairs(ids)
    known = np.flatnonzero((ids[u] != _UNKNOWN) & (ids[w] != _UNKNOWN))
    by, ends = _split(_home_of_pair(ids[u[known]], ids[w[known]], parts), parts)
    return _Asked(pair, u, w, known[by], ends, ids, count)


def _ask_pairs(parts: int, documents: int):
    """(3)."""

    def work(part: int, got: dict) -> Iterator[tuple]:
        ids = defaultdict(list)
        for s, p, data in got[_IDS]:
            ids[s].append((p, data))
        for s, _, uri in got[_SLICE_FILE]:
            file = Slice.load(uri.decode())
            a = _ask(file, ids[s], parts, documents)
            learned = np.bincount(a.pair[np.repeat(file.train, file.length)], minlength=len(a.u))
            for p in range(parts):
                mine = a.order[a.ends[p - 1] if p else 0 : a.ends[p]]
                if len(mine):
                    mine_u, mine_w = a.u[mine], a.w[mine]
                    yield (p, _PAIRS, s, part, pack(a.ids[mine_u], a.ids[mine_w], learned[mine], a.count[mine_u], a.count[mine_w]), None)

    return work


def first_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables at which to begin: with many customers, those beyond the first are nearly Poisson with mean ``weight / discount``."""
    return np.minimum(customers, 1 + rng.poisson(np.minimum(weight / discount, customers))).astype(np.int64)


@lru_cache(maxsize=2)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [n, t] adds up the seatings of n customers at t tables, each the product of its tables' factors."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, most + 1)
    for n in range(most):
        stay = np.log(np.maximum(n - discount * t, 1e-300))
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], np.where(t <= n, out[n, 1:] + stay, -np.inf))
    return out


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables given the weight of a new one: t has the chance weight**t times the Stirling number of (customers, t).

    With t from 1 to T, Stirling numbers times discount**(t-1) (t-1)! / (n-1)! are chances in a restaurant of no strength; for n above EXACT
    these are taken as a function of t / n**discount, which is their limit."""
    table = stirling(round(discount, 6))
    out = np.minimum(customers, 1).astype(np.int64)
    log_weight = np.log(np.maximum(weight, 1e-300))
    order = np.argsort(customers, kind="stable")
    ordered = customers[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    sizes = ordered[starts]
    del ordered
    for n, i, j in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        if n < 2:
            continue
        if n <= EXACT:
            t, base = np.arange(1, n + 1), table[n, 1 : n + 1]
        else:
            scale = (EXACT / n) ** discount
            t = np.arange(1, min(n, int(EXACT / scale)) + 1)
            k = np.arange(1, EXACT + 1)
            at = table[EXACT, 1:] + (k - 1) * np.log(discount) + _log_factorial(EXACT)[:-1]
            base = np.interp(t * scale, k, at) - (t - 1) * np.log(discount) - _log_factorial(len(t))[:-1]
        step = max(1, (1 << 17) // len(t))
        for lo in range(i, j, step):
            at_rows = order[lo : min(j, lo + step)]
            x = base + log_weight[at_rows, None] * t
            x = np.cumsum(np.exp(x - x.max(axis=1, keepdims=True)), axis=1)
            out[at_rows] = 1 + (x <= (rng.random(len(at_rows)) * x[:, -1])[:, None]).sum(axis=1)
    return np.minimum(out, customers)


def _log_factorial(most: int) -> np.ndarray:
    return np.append(0.0, np.cumsum(np.log(np.arange(1, most + 1))))


def gibbs(customers: np.ndarray, weight: Callable[[np.ndarray], np.ndarray], discount: float, rng: np.random.Generator, burn: int = BURN, keep: int = SAMPLES) -> np.ndarray:
    """Samples of the numbers of tables at which the customers of each dish sit, (keep, dishes).

    ``weight`` gives, from the numbers of tables, each dish's weight of a new table.  In a sweep all dishes' numbers of tables are drawn
    anew given the weights, whatever their customers; sweeps go on until the weights have settled, ``burn`` at least."""
    value = weight(np.minimum(customers, 1))
    tables = first_tables(customers, value, discount, rng)
    share = customers / max(1, customers.sum())
    out = np.empty((keep, len(customers)), np.int64)
    sweep, last, calm = 0, np.log(np.maximum(value, 1e-300)) @ share, 0
    while sweep < burn or calm < 2:
        value = weight(tables)
        tables = draw_tables(customers, value, discount, rng)
        now = np.log(np.maximum(value, 1e-300)) @ share
        calm = calm + 1 if abs(now - last) <= SETTLED else 0
        sweep, last = sweep + 1, now
    for k in range(keep):
        out[k] = tables = draw_tables(customers, weight(tables), discount, rng)
    return out


def _seat_pairs(parts: int, total: int, strength: float, seed: int, samples: int):
    """(4); statistics: pairs seen once, pairs seen twice."""

    def work(part: int, got: dict) -> Iterator[tuple]:
        asked, columns = [], []
        for s, home, data in got.pop(_PAIRS):
            columns.append(unpack(data))
            asked.append((s, home, len(columns[-1][0])))
        u, w, learned, cu, cw = map(np.concatenate, zip(*columns))
        del columns
        key, first, at = distinct(pair_keys(u, w))
        c = np.bincount(at, learned, len(key)).astype(np.int64)
        del key, learned
        u, w, cu, cw = (x[first].astype(np.int64) for x in (u, w, cu, cw))
        once, twice = int((c == 1).sum()), int((c == 2).sum())
        d = discount_of(once, twice)
        context, ctx = np.unique(u, return_inverse=True)
        here = np.bincount(ctx, c, len(context))
        rest = np.maximum(0, cu - here[ctx])
        base = cw / max(1, total)
        del first, cu, cw, here

        def weight(tables: np.ndarray) -> np.ndarray:
            mine = np.bincount(ctx, tables, len(context))[ctx]
            return (strength + d * (mine + rest * (tables.sum() / max(1, c.sum())))) * base

        t = gibbs(c, weight, d, np.random.default_rng([seed, part]), keep=samples)
        end = 0
        for k, (s, home, n) in enumerate(asked):
            mine = at[end : end + n]
            end += n
            many = mine[c[mine] > 1]
            yield (home, _TABLES, s, part, pack(c[mine], *t[:, many]), None if k else [once, twice])
        for kind, ids in ((0, w), (1, u)):
            name, which = np.unique(ids[c > 0], return_inverse=True)
            sums = [np.bincount(which, x[c > 0], len(name)).astype(np.int64) for x in t]
            by, ends = _split((name - 2) % parts, parts)
            for p in range(parts):
                mine = by[ends[p - 1] if p else 0 : ends[p]]
                if len(mine):
                    yield (p, _SUMS, part, kind, pack(name[mine], *(x[mine] for x in sums)), None)

    return work


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A number for each pair of ids, equal for equal pairs only: ids of 32 bits and more are numbered anew."""
    if len(u) and max(int(u.max()), int(w.max())) >> 32:
        u, w = distinct(u)[2], distinct(w)[2]
    key = u.astype(np.int64)
    key <<= 32
    key |= w.astype(np.int64)
    return key


def discount_of(once: int, twice: int) -> float:
    """The usual estimate of a discount from the numbers of things seen once and twice."""
    return float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.05, 0.95))


# --- the root --------------------------------------------------------------------------------------------------
@dataclass
class Totals:
    """What all parts of the corpus add up to."""

    documents: int = 0
    tokens: int = 0
    words: int = 0
    words_once: int = 0
    words_twice: int = 0
    pairs_once: int = 0
    pairs_twice: int = 0
    customers: tuple = ()  # of the root, for each sample
    tables: tuple = ()  # of the root
    start_tables: tuple = ()  # of the restaurant of the start

    @property
    def discount(self) -> float:
        return discount_of(self.pairs_once, self.pairs_twice)

    @property
    def root_discount(self) -> float:
        return discount_of(self.words_once, self.words_twice)

    @property
    def unknown(self) -> float:
        """The base measure's probability of unknown words: such that the model meets as many as training words were met once."""
        if not self.words:
            return 1.0
        return float(np.clip(self.words_once / (self.words * self.discount * self.root_discount), 1 / (self.words + 1), 0.9))

    @property
    def known(self) -> float:
        return (1 - self.unknown) / max(1, self.words)


def _seat_root(parts: int, totals: Totals, strength: float, seed: int, samples: int):
    """(5); statistics: for each sample, the root's customers, its tables, and the tables of the start's restaurant."""

    def work(part: int, got: dict) -> Iterator[tuple]:
        v = _Vocabulary(part, parts, got[_WORDS]) if got[_WORDS] else None
        n = len(v.count) if v else 0
        customers, tables = np.zeros((samples, n), np.int64), np.zeros((samples, n + 1), np.int64)  # the last one is the start
        for _, kind, data in got[_SUMS]:
            name, *sums = unpack(data)
            place = (name.astype(np.int64) - 2) // parts
            for k in range(samples):
                np.add.at((customers, tables)[kind][k], place, sums[k].astype(np.int64))
        d = totals.root_discount
        root = np.zeros((samples, n), np.int64)
        for k in range(samples):
            weight = lambda t: np.full(n, (strength + d * totals.words * max(1.0, t.sum() / max(1, n))) * totals.known)
            root[k] = gibbs(customers[k], weight, d, np.random.default_rng([seed, part, k, 1]), keep=1)[0]
        stats = [int(x) for a in (customers.sum(axis=1), root.sum(axis=1), tables[:, n]) for x in a]
        if v is None:
            yield (part, _ROOT, -1, part, None, stats)
            return
        zero = np.zeros((samples, 1), np.int64)
        a, b, t = np.hstack([customers, zero]), np.hstack([root, zero]), np.hstack([tables[:, :n], zero])
        for k, row in enumerate(v.answers(_ROOT, *a, *b, *t)):
            yield row if k else (*row[:5], stats)

    return work


# --- scores ----------------------------------------------------------------------------------------------------
def predictive(c, t, cu, tu, root_customers, root_tables, known, k: int, totals: Totals, strength: float, root_strength: float) -> np.ndarray:
    """The probability of words after their contexts in sample ``k``.

    c, t: customers and tables of the pair; cu, tu: of the context's restaurant; known: whether the word was seen."""
    d, e = totals.discount, totals.root_discount
    base = np.where(known, totals.known, totals.unknown)
    word = (root_customers - e * root_tables + (root_strength + e * totals.tables[k]) * base) / (root_strength + totals.customers[k])
    return (c - d * t + (strength + d * tu) * word) / (strength + cu)


def _score_slices(parts: int, totals: Totals, strength: float, root_strength: float, samples: int):
    """(6): rows (doc_id, n_tokens, n_known, base_score, score)."""

    def one(mine: dict) -> pa.RecordBatch:
        file = Slice.load(mine[_SLICE_FILE][0][1].decode())
        a = _ask(file, mine[_IDS], parts, totals.documents)
        root = _named(file, mine[_ROOT], parts, 3 * samples)
        v = len(file.salt)
        c, t = np.zeros(len(a.u), np.int64), np.zeros((samples, len(a.u)), np.int64)
        for p, data in mine[_TABLES]:
            at = a.order[a.ends[p - 1] if p else 0 : a.ends[p]]
            count, *tables = unpack(data)
            c[at] = count
            many = at[count > 1]
            for k in range(samples):
                t[k, at] = np.minimum(count, 1)
                t[k, many] = tables[k]
        known = a.count[a.w] > 0
        mean = np.zeros(len(a.u))
        for k in range(samples):
            tu = np.append(root[2 * samples + k], totals.start_tables[k])
            mean += predictive(c, t[k], a.count[a.u], tu[a.u], root[k][a.w], root[samples + k][a.w], known, k, totals, strength, root_strength)
        del c, t
        base = np.log10((a.count[:v] + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))
        starts = np.append(0, np.cumsum(file.length)[:-1])
        cols = [
            pa.array(file.doc_id, mask=~file.known_id),
            pa.array(file.length),
            pa.array(np.add.reduceat((a.count[:v] > 0).astype(np.int64)[file.token], starts)),
            pa.array(np.add.reduceat(base[file.token], starts)),
            pa.array(np.add.reduceat(np.log10(mean / samples)[a.pair], starts)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = defaultdict(lambda: defaultdict(list))
        for b in batches:
            for kind, s, p, data in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                got[s][kind].append((p, data))
        b = data = None
        for s in sorted(got):
            if got[s][_SLICE_FILE]:
                out = one(got.pop(s))
                give_back()
                yield out

    return run


def _sums(messages: DataFrame, n: int) -> list[int]:
    return [int(x or 0) for x in messages.agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(n)]).first()]


def score_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    fold: int = FOLD,
    folds: int = FOLDS,
    strength: float = STRENGTH,
    root_strength: float = ROOT_STRENGTH,
    samples: int = SAMPLES,
    seed: int = 20240229,
    slice_bytes: int = SLICE,
) -> DataFrame:
    """One row per input row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    A-Z are lower-cased; tokens are runs without ASCII white space, and one end for each text.  The model learns from the rows
    whose crc32 of the id as text leaves another remainder than ``fold`` modulo ``folds``.  ``base_score`` is the smoothed unigram log10 probability of the text,
    ``score`` the model's, in which all unknown words are one word.  Words are told apart by 64 bits of hash.

    Null and empty texts have one token, the end.  A row with a null id is learned from.  Repeated rows count as often as they come.  Without
    training rows the unknown word has probability one.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 14)
    key = F.col(f"`{id_col}`").cast("long")
    out_of = F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    src = docs.select(key.alias("doc_id"), (~out_of).alias("train"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    asked = cut(src.mapInArrow(_scan(parts, fresh_path(spark, "lm-slices"), slice_bytes), _MSG), "lm-words")
    files, words = asked.where(F.col("kind") == _SLICE_FILE), asked.where(F.col("kind") == _WORDS)
    totals = Totals(documents=_sums(files, 1)[0])
    ids = cut(_deliver(words, parts, _number_words(parts)), "lm-ids")
    totals.tokens, totals.words, totals.words_once, totals.words_twice = _sums(ids, 4)
    pairs = _deliver(files.unionByName(ids), parts, _ask_pairs(parts, totals.documents))
    seated = cut(_deliver(pairs, parts, _seat_pairs(parts, totals.tokens, strength, seed, samples)), "lm-tables")
    totals.pairs_once, totals.pairs_twice = _sums(seated, 2)
    sums, tables = seated.where(F.col("kind") == _SUMS), seated.where(F.col("kind") == _TABLES)
    root = cut(_deliver(words.unionByName(sums), parts, _seat_root(parts, totals, root_strength, seed, samples)), "lm-root")
    got = _sums(root, 3 * samples)
    totals.customers, totals.tables, totals.start_tables = (tuple(got[i : i + samples]) for i in range(0, 3 * samples, samples))
    every = files.unionByName(ids).unionByName(tables).unionByName(root.where("slice >= 0"))
    scored = every.repartitionById(parts, F.col("to")).mapInArrow(_score_slices(parts, totals, strength, root_strength, samples), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
