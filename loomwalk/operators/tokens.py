"""WordPiece tokenisation, special tokens, and token-level tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X

#: A vocabulary is broadcast to the workers; a larger one is refused.
MOST_VOCABULARY = 2_000_000


def load_vocabulary(spark, path: str) -> DataFrame:
    """(id, token): the lines of one file in their order, numbered from 0; the file is bounded by MOST_VOCABULARY lines."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("id", "token"))


def pieces(word: str, vocabulary: dict[str, int] | set[str], unknown: str = "[UNK]", most: int = 100) -> list[str]:
    """The longest known prefix, then the longest known continuation (``##``) of the rest, and so on; unknown if that fails or the word is too long."""
    if len(word) > most:
        return [unknown]
    out, i = [], 0
    while i < len(word):
        for j in range(len(word), i, -1):
            p = word[i:j] if i == 0 else "##" + word[i:j]
            if p in vocabulary:
                break
        else:
            return [unknown]
        out.append(p)
        i = j
    return out


def wordpiece(words: Column, vocabulary: list[str], spark, *, unknown: str = "[UNK]") -> Column:
    """The word pieces of an array of words."""
    if len(vocabulary) > MOST_VOCABULARY:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = spark.sparkContext.broadcast(frozenset(vocabulary))

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        memo: dict[str, list[str]] = {}
        vocab = shared.value

        def get(w: str) -> list[str]:
            if w not in memo:
                memo[w] = pieces(w, vocab, unknown)
            return memo[w]

        return s.map(lambda ws: None if ws is None else [p for w in ws for p in get(w)])

    return run(words)


def to_ids(rows: DataFrame, vocabulary: DataFrame, *, key: str, unknown: int, tokens_col: str = "pieces") -> DataFrame:
    """(key, ids): tokens by their ids, unknown ones as ``unknown``; the vocabulary is joined, not collected."""
    flat = rows.select(key, F.posexplode(tokens_col).alias("pos", "token"))
    named = flat.join(vocabulary.select("token", "id"), "token", "left").select(key, F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id")).alias("x"))
    return named.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x")).select(key, F.col("x.id").alias("ids"))


def to_text(pieces_col: Column) -> Column:
    """Pieces joined back to words."""
    return F.trim(F.replace(F.array_join(pieces_col, " "), F.lit(" ##"), F.lit("")))


def with_specials(a: Column, b: Column | None = None, *, cls: int = A.CLS, sep: int = A.SEP) -> tuple[Column, Column, Column]:
    """(ids, type ids, special mask) of one sequence or a pair."""
    one = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep)))
    first = A.repeat(0, F.size(a) + 2)
    mask = F.concat(F.array(F.lit(1)), A.repeat(0, F.size(a)), F.array(F.lit(1)))
    if b is None:
        return one, first, mask
    return F.concat(one, b, F.array(F.lit(sep))), F.concat(first, A.repeat(1, F.size(b) + 1)), F.concat(mask, A.repeat(0, F.size(b)), F.array(F.lit(1)))


def token_counts(rows: DataFrame, size: int, *, tokens_col: str = "tokens") -> DataFrame:
    """(token, n) for every id of a vocabulary of ``size``, zeros included."""
    n = rows.select(F.explode(tokens_col).alias("token")).groupBy(F.col("token").cast("long").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(size).select(F.col("id").alias("token"))
    return every.join(n, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def label_frequencies(rows: DataFrame, *, labels_col: str) -> DataFrame:
    return rows.select(F.explode(labels_col).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def multi_hot(labels: Column, vocabulary: list[str]) -> Column:
    return F.array(*[F.array_contains(labels, v).cast("int") for v in vocabulary])


def word_labels(rows: DataFrame, *, most: int, cls: int = A.CLS, sep: int = A.SEP, ignore: int = -100) -> DataFrame:
    """(doc_id, ids, labels) of (doc_id, pieces: arrays of ids by word, labels: by word): the first piece of a word has its label, the others ``ignore``; cut to
    ``most`` with the special tokens."""
    flat = F.flatten("pieces")
    tags = F.flatten(F.zip_with("pieces", "labels", lambda p, y: F.concat(F.array(y), A.repeat(ignore, F.greatest(F.size(p) - 1, F.lit(0))))))
    cut = lambda c: F.slice(c, F.lit(1), F.lit(most - 2))
    i = F.lit(ignore)
    return rows.select("doc_id", F.concat(F.array(F.lit(cls)), cut(flat), F.array(F.lit(sep))).alias("ids"), F.concat(F.array(i), cut(tags), F.array(i)).alias("labels"))


def delimited_records(lines: DataFrame, *, group_col: str, order_col: str, line_col: str = "line", marker: str = "-DOCSTART-") -> DataFrame:
    """(group, record, n, first): runs of lines between blank or marker lines, numbered from 0 in each group; a window inside one group."""
    brk = (F.trim(F.col(line_col)) == "") | F.startswith(F.col(line_col), F.lit(marker))
    w = W.partitionBy(group_col).orderBy(order_col).rowsBetween(W.unboundedPreceding, 0)
    runs = lines.withColumn("__b", brk.cast("int")).withColumn("__r", F.sum("__b").over(w)).where("__b = 0")
    out = runs.groupBy(group_col, "__r").agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("first"))
    record = F.row_number().over(W.partitionBy(group_col).orderBy("__r")) - 1
    return out.select(group_col, record.cast("long").alias("record"), "n", "first")


def mask_references(words: Column, lexicon: list[str], spark) -> Column:
    """0-based places of the characters that continue a word of the lexicon, by the longest match from the left."""
    shared = spark.sparkContext.broadcast((frozenset(lexicon), max(map(len, lexicon), default=1)))

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        known, longest = shared.value

        def one(chars: list[str] | None):
            if chars is None:
                return None
            out, i = [], 0
            while i < len(chars):
                j = next((j for j in range(min(len(chars), i + longest), i + 1, -1) if "".join(chars[i:j]) in known), i + 1)
                out += range(i + 1, j)
                i = j
            return out

        return s.map(one)

    return run(words)


def accented_words(text: Column) -> Column:
    return X.split_squeezed(X.squeeze(X.strip_accents(F.lower(text))))
