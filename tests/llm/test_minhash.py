import random

import numpy as np
import pytest

from loomwalk.llm import minhash, words

from .helpers import documents, near_duplicates

RNG = random.Random(5)


def text(n):
    return " ".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") * RNG.randint(1, 3) + str(RNG.randint(0, 400)) for _ in range(n))


def changed(t, k):
    w = t.split(" ")
    for _ in range(k):
        w[RNG.randrange(len(w))] = f"new{RNG.random()}"
    return " ".join(w)


def table():
    rows = []
    for g in range(12):
        t = text(RNG.choice([30, 120, 400]))
        rows += [t, t.upper(), *(changed(t, k) for k in (1, 1, 2, 3, 8))]
    rows += [None, "", " \t\n", "one", "One", "two words", "two  words", "a b c d e", "A B C D E", text(20_000)]
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_components_are_those_of_all_pairs(spark, percent):
    rows = table()
    out = minhash.near_duplicates(documents(spark, rows), percent=percent, bands=40, rows=6).collect()
    want = near_duplicates(rows, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_one_large_group_of_near_copies(spark):
    t = text(300)
    rows = [(i, changed(t, i % 5)) for i in range(150)]
    out = minhash.near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: c for i, (_, c) in near_duplicates(rows).items()}


def test_large_bucket_in_blocks(spark, monkeypatch):
    """Sets that share a band but are not all alike: chains of links inside one bucket."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 3000)
    base = [f"w{i}" for i in range(400)]
    rows = [(g, " ".join(base[g : g + 200])) for g in range(0, 120, 2)]
    out = minhash.near_duplicates(documents(spark, rows), bands=64, rows=1).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: c for i, (_, c) in near_duplicates(rows).items()}


def test_empty_table_and_dropping(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    rows = table()
    docs = documents(spark, rows)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in near_duplicates(rows).items() if i == c}


def test_signature_is_circulant():
    """Coordinate j is the least value of the second permutation shifted by j, over the positions of the first."""
    h = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    k = 20
    p = minhash._permutation(k)
    at = (words.mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - minhash._DOMAIN_BITS)).astype(int)
    assert minhash.signature(h, k).tolist() == [min(p[a + j] for a in at) for j in range(k)]


def test_rows_with_one_id_and_different_texts(spark):
    """No text is lost for sharing its id with a copy, and inner names may be names of columns."""
    a, b = "a text of several words that comes more than once", "another text that comes once only in this table"
    rows = [(1, a), (5, a), (5, b), (7, b), (5, ""), (None, a), (5, b)]
    docs = documents(spark, rows).selectExpr("*", "1 as __gone", "2 as __row", "3 as __id")
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (5, ""), (5, b), (5, b)]
