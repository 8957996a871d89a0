"""Memory of a task: what a slice or a partition takes beside its own arrays."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loomwalk.llm import lm


def _peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tokens_take_a_few_bytes_for_each_byte_of_text():
    texts = pa.array(["some words Of an ordinary Text and others\n" * 200] * 250 + [None, ""])
    lm.tokens_of(texts)
    assert _peak(lambda: lm.tokens_of(texts)) < 20 * texts.nbytes


def test_pairs_of_a_slice():
    rng = np.random.default_rng(5)
    n, none = 400_000, np.zeros(0)
    file = lm.Slice(none, none, none, np.array([n - 3, 3]), rng.integers(0, 3000, n).astype(np.int32), np.zeros(3000, np.int64))
    assert _peak(lambda: file.pairs(np.arange(3000))) < 55 * n
    u, w, pair = file.pairs(np.arange(3000))
    before = np.append(3000, file.token[:-1])
    before[n - 3] = 3000
    assert (u[pair] == before).all() and (w[pair] == file.token).all()
    assert len({*zip(u.tolist(), w.tolist())}) == len(u)


def test_pairs_of_a_partition():
    rng = np.random.default_rng(6)
    u, w = rng.integers(2, 900, (2, 300_000))
    got = [(s, 0, lm.pack(u, w, np.ones_like(u), np.full_like(u, 2000), np.full_like(u, 1800))) for s in range(3)]
    lm.stirling(0.5)
    seat = lm._seat_pairs(4, 300_000, 1.0, 7, 3)
    list(seat(0, {lm._PAIRS: list(got)}))
    assert _peak(lambda: list(seat(0, {lm._PAIRS: list(got)}))) < 70 * 3 * len(u)
