"""Quality heuristics, flags and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: Thresholds and keywords of the heuristics.
LINE_MAX, LINE_MEAN, ALNUM, CHARS_PER_TOKEN = 1000, 100, 0.25, 1.5
AUTOGENERATED = ["auto-generated", "autogenerated", "automatically generated"]
TESTS = ["unit tests", "test file", "configuration file"]
CODE = ["def ", "class ", "for ", "while "]


def features(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(doc_id, line_mean, line_max, alnum_fraction, ratio, autogenerated, config_or_test, has_no_keywords, has_few_assignments).

    ``ratio`` is characters per word.  Null texts count as empty."""
    t = docs.select("doc_id", F.coalesce(text_col, F.lit("")).alias("t"))
    lens = X.line_lengths(F.col("t"))
    head = F.slice(F.split("t", "\n"), F.lit(1), F.lit(5))
    low = F.lower("t")
    named = lambda lines, words: F.exists(lines, lambda x: F.array_contains(F.array(*[F.contains(F.lower(x), F.lit(w)) for w in words]), True))
    n_lines = F.size(F.split("t", "\n"))
    density = lambda word: X.occurrences(low, word) > F.floor(n_lines * 0.05)
    return t.select(
        "doc_id",
        F.round(F.aggregate(lens, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(lens), 6).alias("line_mean"),
        F.array_max(lens).cast("long").alias("line_max"),
        F.round(F.coalesce(X.alnum_fraction(F.col("t")), F.lit(0.0)), 6).alias("alnum_fraction"),
        F.round(F.coalesce(F.try_divide(F.length("t"), F.size(X.words(F.col("t")))), F.lit(0.0)), 6).alias("ratio"),
        named(head, AUTOGENERATED).alias("autogenerated"),
        (named(head, TESTS) | density("config") | density("test")).alias("config_or_test"),
        (~F.array_contains(F.array(*[F.contains(low, F.lit(k)) for k in CODE]), True)).alias("has_no_keywords"),
        (X.occurrences(F.col("t"), "=") <= 4).alias("has_few_assignments"),
    )


def chance(key: Column, seed: str = "") -> Column:
    """A number in [0, 1000) from a hash of ``key``: a sample that every run and engine agrees on."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed))), 1, 7), 16, 10).cast("long") % 1000


def quality_filter(feats: DataFrame, *, p: float = 0.3) -> DataFrame:
    """The rows of ``features`` that pass; of configuration and test files, files without keywords and files with few assignments, a share ``p`` by hash."""
    good = (F.col("line_max") <= LINE_MAX) & (F.col("line_mean") <= LINE_MEAN) & (F.col("alnum_fraction") >= ALNUM) & (F.col("ratio") >= CHARS_PER_TOKEN) & ~F.col("autogenerated")
    odd = F.col("config_or_test") | F.col("has_no_keywords") | F.col("has_few_assignments")
    return feats.where(good & (~odd | (chance(F.col("doc_id")) < int(p * 1000))))


def confident_top(rows: DataFrame, *, score_col: str, least: float, share: float, id_col: str = "doc_id") -> DataFrame:
    """Rows above ``least`` and of those the best ``int(share * n)``, ties by id; ``rank`` from 1."""
    from ..storage import numbered

    kept = rows.where(F.col(score_col) > least)
    n = kept.count()
    placed = numbered(kept.withColumn("__neg", -F.col(score_col)), "__neg", id_col, out="rank")
    return placed.where(F.col("rank") < int(share * n)).withColumn("rank", F.col("rank") + 1).drop("__neg")


def gain_filter(rows: DataFrame, *, step_col: str, gain_col: str, first: int = 10) -> DataFrame:
    """Rows whose gain reaches 1.0 in the first steps and -1.0 after them."""
    return rows.where(F.when(F.col(step_col) < first, F.col(gain_col) >= 1.0).otherwise(F.col(gain_col) >= -1.0))


def length_filter(rows: DataFrame, *, columns: list[str], below: int, category_col: str | None = None) -> DataFrame:
    """Rows whose texts are shorter than ``below`` in all and whose category is not ``null``."""
    total = sum((F.length(F.coalesce(c, F.lit(""))) for c in columns[1:]), F.length(F.coalesce(columns[0], F.lit(""))))
    out = rows.where(total < below)
    return out.where(F.col(category_col) != "null") if category_col else out


def drop_indices(rows: DataFrame, remove: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    return rows.join(remove.select(id_col).dropDuplicates(), id_col, "left_anti")


def head_per_group(rows: DataFrame, n: int, *, group_col: str, order_col: str) -> DataFrame:
    """The first ``n`` rows of each group."""
    r = F.row_number().over(W.partitionBy(group_col).orderBy(order_col))
    return rows.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def require(condition: Column, message: str) -> Column:
    """True, or an error that stops the query."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def metadata_id(doc: DataFrame) -> DataFrame:
    """``doc`` with ``doc_name``: ``id``, else ``meta.filename``; it is an error to have neither."""
    name = F.coalesce(F.col("id"), F.col("meta.filename"))
    return doc.withColumn("doc_name", F.when(name.isNotNull(), name).otherwise(F.raise_error("a document needs an id or a file name").cast("string")))


def known_share(rows: DataFrame, *, unknown: int, most: float = 0.5, least: int = 11) -> DataFrame:
    """Sequences longer than ``least`` of which less than ``most`` is ``unknown``."""
    share = F.size(F.filter("tokens", lambda x: x == unknown)) / F.size("tokens")
    return rows.where(F.size("tokens") > least).where(share < most)
