"""Golden and edge cases of column functions."""

import math

import pytest
from pyspark.sql import functions as F

from loomwalk.functions import arrays as A
from loomwalk.functions import text as X
from loomwalk.functions import vectors as V


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(v for v, _ in cols.values())], ", ".join(f"{k} {t}" for k, (_, t) in cols.items())) if cols else spark.range(1)
    return df.select(column.alias("x")).first().x


def ints(spark, column, a, **more):
    return value(spark, column, a=(a, "array<int>"), **more)


@pytest.mark.parametrize("a, want", [([1, 10, 3], [1, 10, 0]), ([3, 10, 5, 6], [3, 10, 0, 0]), ([1, 2], [1, 2]), ([], []), ([10], [10])])
def test_mask_after(spark, a, want):
    assert ints(spark, A.mask_after(F.col("a"), 10), a) == want


def test_padding(spark):
    a = F.col("a")
    assert ints(spark, A.pad_right(a, 5), [1, 2]) == [1, 2, 0, 0, 0]
    assert ints(spark, A.pad_right(a, 1), [1, 2]) == [1]
    assert ints(spark, A.pad_left(a, 4), [1, 2]) == [0, 0, 1, 2]
    assert ints(spark, A.pad_left(a, 1), [1, 2]) == [2]
    assert ints(spark, A.pad_left(a, 2), []) == [0, 0]
    assert ints(spark, A.up_to_multiple(F.size(a), 8), [1] * 9) == 16
    assert ints(spark, A.attention_mask(F.size(a), F.lit(4)), [1, 2]) == [1, 1, 0, 0]


def test_shifts(spark):
    a = F.col("a")
    assert ints(spark, A.roll_cls_sep(a), [7, 8, 0, 0]) == [101, 7, 8, 102]
    assert ints(spark, A.roll_cls_sep(a), [7, 0, 0, 0]) == [101, 7, 102, 0]
    assert ints(spark, A.roll_cls_sep(a), [7, 8, 9]) == [101, 7, 8]
    assert ints(spark, A.prepend_drop_last(a), [7, 8]) == [101, 7]
    assert ints(spark, A.shift_right(a), [7, 8]) == [0, 7]
    assert ints(spark, A.used_length(a), [1, 0, 2, 0]) == 3
    assert ints(spark, A.used_length(a), []) == 0


def test_find_runs(spark):
    f = A.find_runs(F.col("a"), F.col("b"))
    assert ints(spark, f, [1, 2, 1, 2, 1], b=([1, 2], "array<int>")) == [0, 2]
    assert ints(spark, f, [1], b=([1, 2], "array<int>")) == []
    assert ints(spark, f, [1], b=([], "array<int>")) == []
    assert ints(spark, A.chunked(F.col("a"), 2), [1, 2, 3]) == [[1, 2], [3]]
    assert ints(spark, A.chunked(F.col("a"), 2), []) == []


def words(spark, column, t):
    return value(spark, column, t=(t, "string"))


def test_basic_tokens_goldens(spark):
    t = F.col("t")
    assert words(spark, X.basic_tokens(t, lower=False), "ah博推zz") == ["ah", "博", "推", "zz"]
    assert words(spark, X.basic_tokens(t), " \tHeLLo!how  \n Are yoU?  ") == ["hello", "!", "how", "are", "you", "?"]
    assert words(spark, X.basic_tokens(t), "Héllo") == ["hello"]
    assert words(spark, X.basic_tokens(t, accents=True), "HäLLo") == ["hällo"]
    assert words(spark, X.basic_tokens(t), "a\n'll !!to?'d of, can't.") == ["a", "'", "ll", "!", "!", "to", "?", "'", "d", "of", ",", "can", "'", "t", "."]
    assert words(spark, X.basic_tokens(t), "") == []
    assert words(spark, X.basic_tokens(t), "$`a") == ["$", "`", "a"]


@pytest.mark.parametrize("t, want", [("1,000.7", 1000.7), ("1,000", 1000.0), ("5,5556", 5.5556), ("0.0.0.1", None), ("0,0,0,1", None), ("12", 12.0), ("-3.5", -3.5), ("x", None), ("", None)])
def test_to_number(spark, t, want):
    assert words(spark, X.to_number(F.col("t")), t) == want


def test_strings(spark):
    t = F.col("t")
    assert words(spark, X.normal_answer(t), "The  Cat, a dog!") == "cat dog"
    assert words(spark, X.char_ngrams(t), "abab") == ["aba", "bab"]
    assert words(spark, X.char_ngrams(t), "ab") == []
    assert words(spark, X.plain_name(t), "a/b-c") == "a_b_c"
    assert words(spark, X.cut_at_last(t, ["\nclass", "\ndef"]), "x\ndef a\nclass b") == "x\ndef a"
    assert words(spark, X.cut_at_last(t, ["#"]), "none") == "none"
    assert words(spark, X.aliases(t), "New York City") == ["New York City", "York City", "New York"]
    assert words(spark, X.aliases(t), "one") == ["one"]
    assert words(spark, X.fill_blank(t, F.lit("z")), "a _ b") == "a z b"
    assert words(spark, X.fill_blank(t, F.lit("z")), "a b") == "a b z"
    assert words(spark, X.occurrences(t, "ab"), "ababab") == 3
    assert [words(spark, X.two_digits(t.cast("int")), x) for x in ("3", "12")] == ["03", "12"]
    assert words(spark, X.clean(t), "a\x00b�c\td​e") == "abc de"


def test_jaccard_of_three(spark):
    a = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789z0y1x2w3v4u5t6s7r8q9pAoBnCmDlEkFjGiHhI"[:100]
    b = a[:95] + "!@$%^"
    c = "&*()-" + b[5:]
    g = lambda s: X.char_ngrams(F.lit(s))
    got = spark.range(1).select(*[F.round(X.jaccard(g(x), g(y)), 6) for x, y in ((a, b), (b, c), (a, c))]).first()
    assert tuple(got) == (0.902913, 0.902913, 0.814815)
    assert spark.range(1).select(X.jaccard(g(""), g("a"))).first()[0] is None


def test_vectors(spark):
    a, b = F.array(*map(F.lit, (1.0, 2.0))), F.array(*map(F.lit, (3.0, -1.0)))
    got = spark.range(1).select(V.dot(a, b), V.l2(a, b), V.cosine(a, b), V.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), V.is_zero(b), V.softmax(a)).first()
    assert got[0] == 1.0 and got[1] == pytest.approx(math.sqrt(13)) and got[2] == pytest.approx(1 / math.sqrt(50)) and got[3] is None and got[4] is False
    assert got[5] == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    keep = spark.range(1).select(V.keep_top_k(F.array(*map(F.lit, (0.1, 5.0, 3.0, 2.0))), 0.5)).first()[0]
    assert keep == [None, 5.0, 3.0, None]
    key = spark.range(50).select(V.gumbel_key(F.lit(1.0), 1.0, 3).alias("k"))
    assert key.where("k is null").count() == 0
