"""Training takes little memory beside its sample, and finds the same."""

import random
import tracemalloc

import numpy as np

from loomwalk.llm import toxicity


def _peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_clauses_take_a_few_bytes_for_each_byte_of_text():
    texts = ["Some ordinary words. Of a text, and o t h e r s!\n" * 200] * 600 + ["", "...", "i.d.i.o.t é"]
    assert _peak(lambda: toxicity.clauses_in(texts)) < 20 * sum(map(len, texts))
    few = texts[-5:]
    a, b = toxicity.clauses_in(few), toxicity.clauses_of(*toxicity._bytes(few))
    assert a.strings() == b.strings() and (a.text == b.text).all() and (a.clause == b.clause).all()
    assert len(toxicity.clauses_in([])) == 0


def test_the_machine_has_no_second_copy_of_its_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 256)).astype(np.float32)
    y = np.where(x[:, 0] + rng.normal(size=len(x)) > 0, 1.0, -1.0)
    assert _peak(lambda: toxicity._svm(x, y, cost=5.0 / (y > 0).sum())) < x.nbytes


def test_training():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=500)) + (" you moronic scumbag." if i % 3 == 0 else ".") for i in range(900)]
    labels = [int(i % 3 == 0) for i in range(len(texts))]
    assert _peak(lambda: toxicity.train(texts, labels)) < 160 << 20
