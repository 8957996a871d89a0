"""Edit distances of lines stop where the bound is passed."""

import random
import time

from pyspark.sql import functions as F

from loomwalk.llm import line_dedup as L


def _similar(spark, rows):
    df = spark.createDataFrame(rows, "ta string, tb string").select("*", F.lit(None).cast("string").alias("ca"), F.lit(None).cast("string").alias("cb"))
    return [r[0] for r in df.select(L.similar(*[F.col(c) for c in ("ta", "tb", "ca", "cb")])).collect()]


def _word(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def test_the_rest_of_a_line_is_not_compared_once_the_bound_is_passed(spark):
    """Gaps between anchors that pass the bound, then hundreds of words that both lines have in another order: one large gap."""
    rng, rows = random.Random(3), []
    for _ in range(200):
        x, y = [], []
        for k in range(12):
            x += [f"anchor{k}", _word(rng, 90)]
            y += [f"anchor{k}", _word(rng, 90), "z"]
        common = [_word(rng, 5) for _ in range(450)]
        u, v = " ".join(common), " ".join(common[::-1])
        rows.append((f"{' '.join(x)} {u}", f"{' '.join(y)} {v}", u, v))
    none = F.lit(None).cast("string")
    df = spark.createDataFrame(rows, "ta string, tb string, u string, v string").cache()
    took = {}
    for _ in range(2):  # the second time, code is compiled
        for name, value in (("gap", F.levenshtein("u", "v") < 0), ("lines", L.similar(F.col("ta"), F.col("tb"), none, none))):
            began = time.monotonic()
            assert df.where(value).count() == 0
            took[name] = time.monotonic() - began
    assert took["lines"] < 0.6 * took["gap"]


def test_the_bound_is_met_exactly(spark):
    """A hundred characters, of which twenty and twenty-one are replaced, two in a word: compared word for word, and between anchors where a word is split."""
    words = [f"{c}{c}{c}{d}" for c in "abcde" for d in "fghi"]
    words[-1] += "i"
    line = " ".join(words)
    assert len(line) == 100

    def changed(n):
        return [f"{'9' * min(2, max(0, n - 2 * i))}{w[min(2, max(0, n - 2 * i)) :]}" for i, w in enumerate(words)]

    assert _similar(spark, [(line, " ".join(changed(n))) for n in (20, 21)]) == [True, False]
    half = " ".join(words[:8] + ["99999999999999999999"] + words[8:])
    assert _similar(spark, [(half, " ".join(words[:8] + [x] + words[8:])) for x in ("8" * 20, "8 8" + "9" * 17, "88888888 8888888888888888888")]) == [True, True, False]
