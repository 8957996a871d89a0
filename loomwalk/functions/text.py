"""Functions of texts: columns in, columns out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
#: Ids of hashed tokens start here; the ids below are special.
FIRST_ID, IDS = 1000, 29000
#: The ranges of CJK ideographs.
CJK = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]


def words(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def hash_tokens(text: Column) -> Column:
    """Token ids of words without a vocabulary: a stand-in for a trained tokenizer."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % IDS) + FIRST_ID)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The distinct substrings of ``n`` characters."""
    most = F.length(text) - n + 1
    return F.when(most >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Null if both sets are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def clean(text: Column) -> Column:
    """Without NUL, U+FFFD and control characters; white space becomes a space."""
    spaced = F.regexp_replace(text, r"[\t\n\r\p{Zs}]", " ")
    return F.regexp_replace(spaced, r"[\x{0}\x{FFFD}\p{Cc}\p{Cf}\p{Co}\p{Cs}]", "")


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Without combining marks, after canonical decomposition; Spark has no built-in for it."""
    return s.map(lambda t: None if t is None else t if t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def space_cjk(text: Column) -> Column:
    ranges = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK)
    return F.regexp_replace(text, f"[{ranges}]", " $0 ")


def space_punctuation(text: Column) -> Column:
    """A space on both sides of each punctuation mark; ASCII symbols count as such."""
    return F.regexp_replace(text, r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}]", " $0 ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def split_squeezed(text: Column) -> Column:
    """The words of a squeezed text; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def basic_tokens(text: Column, *, lower: bool = True, accents: bool = False) -> Column:
    """Cleaned words with punctuation and CJK characters on their own; with ``lower``, lower-cased, and without accents unless ``accents``."""
    t = squeeze(space_cjk(clean(text)))
    if lower:
        t = F.lower(t)
        if not accents:
            t = strip_accents(t)
    return split_squeezed(squeeze(space_punctuation(t)))


def normal_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    t = F.regexp_replace(F.lower(text), r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", "")
    return squeeze(F.regexp_replace(t, r"\b(a|an|the)\b", " "))


def two_digits(n: Column) -> Column:
    """A number below ten with a leading zero."""
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def plain_name(name: Column) -> Column:
    return F.translate(name, "/-", "__")


def to_number(text: Column) -> Column:
    """A number in a table cell: thousands separators go; one comma that does not stand before three digits is a decimal point; what has
    several points, or is no number, is null.

    ``1,000.7`` is 1000.7, ``1,000`` is 1000, ``5,5556`` is 5.5556, ``0.0.0.1`` and ``0,0,0,1`` are null."""
    t = F.trim(text)
    thousands = t.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$")
    decimal = t.rlike(r"^[+-]?\d+,\d+$")
    plain = F.when(thousands, F.replace(t, F.lit(","), F.lit(""))).when(decimal, F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.cast("double"))


def cut_at_last(text: Column, stops: list[str]) -> Column:
    """The text before the last place at which a stop occurs; the whole text if none does."""
    pattern = "(?s)^(.*)(?:" + "|".join(rf"\Q{s}\E" for s in stops) + ").*$"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def passage(title: Column, text: Column, question: Column) -> Column:
    """A retrieval input: title / text // question."""
    return F.concat(title, F.lit(" / "), text, F.lit(" // "), question)


def aliases(answer: Column) -> Column:
    """An answer's variants: itself, without its first word, without its last word, with punctuation turned to spaces."""
    w = split_squeezed(squeeze(answer))
    n = F.size(w)
    rest = F.when(n > 1, F.array(F.array_join(F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), " "), F.array_join(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), " "))).otherwise(F.array().cast("array<string>"))
    plain = squeeze(F.regexp_replace(answer, r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", " "))
    return F.array_distinct(F.concat(F.array(answer), rest, F.array(plain)))


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def line_lengths(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.length(x))


def alnum_fraction(text: Column) -> Column:
    """The share of characters that are letters or digits."""
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.length(text))


def fill_blank(question: Column, ending: Column) -> Column:
    """The ending in place of the blank, or after the question where there is none."""
    return F.when(F.instr(question, "_") > 0, F.replace(question, F.lit("_"), ending)).otherwise(F.concat(question, F.lit(" "), ending))
