"""Whole lines against edit similarity alone, by brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from loomwalk.llm import line_dedup as L

from .helpers import documents
from .test_line_dedup import distance

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 11))) for _ in range(400)]


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def dropped(spark, rows):
    return {r.doc_id: r.n_dropped for r in L.dedup_lines(documents(spark, rows)).collect()}


@pytest.mark.parametrize("low, high, least", [(5, 7, 0.9), (8, 12, 0.95), (13, 40, 0.97)])
def test_recall_of_a_replaced_word(spark, low, high, least):
    """Whichever word is replaced; only edits that leave a similarity of 0.8 count, by brute force."""
    rows, good, k = [], [], 0
    while len(good) < 150:
        w = sentence(RNG.randint(low, high)).split(" ")
        v = list(w)
        v[RNG.randrange(len(v))] = RNG.choice(VOCAB)
        a, b = " ".join(w), " ".join(v)
        if a != b and distance(a, b) * 100 <= 20 * max(len(a), len(b)):
            rows += [(2 * k, a), (2 * k + 1, b)]
            good.append(2 * k + 1)
            k += 1
    out = dropped(spark, rows)
    assert sum(out[i] for i in good) >= least * len(good)
    assert not any(out[2 * i] for i in range(k))


def test_links_are_those_of_the_characters(spark):
    pairs = [("abcdefghij", "abcdefghxx"), ("abcdefghij", "abcdefgxxx"), ("", "a")]
    df = spark.createDataFrame([(a, b, a, b) for a, b in pairs], "ta string, tb string, ca string, cb string")
    got = [r[0] for r in df.select(L.similar(*[F.col(c) for c in df.columns])).collect()]
    assert got == [True, False, False]


def test_long_lines_behind_another_lead(spark):
    body = sentence(300)
    rows = [(i, f"{sentence(n)} {body}") for i, n in enumerate((0, 1, 3, 10, 20))]
    assert dropped(spark, rows) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_typos_in_a_short_line(spark):
    assert dropped(spark, [(0, "please subscribe to our weekly newsletter right now"), (1, "please subscrlbe to our weekly newslettor right now")]) == {0: 0, 1: 1}


def test_short_copies_and_scripts_without_spaces(spark):
    han = "本网站使用饼干来改善您的体验，继续浏览即表示您同意我们的隐私政策和使用条款。"
    rows = [(0, "Subscribe to our newsletter"), (1, "Subscribe to our newsletter!"), (2, han), (3, han), (4, han.replace("改善", "提高")), (5, "---\n\n"), (6, "---\n\n"), (7, "เว็บไซต์นี้ใช้คุกกี้เพื่อประสบการณ์ที่ดี"), (8, "เว็บไซต์นี้ใช้คุกกี้เพื่อประสบการณ์ที่ดี")]
    assert dropped(spark, rows) == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 1}
