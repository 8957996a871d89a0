"""Functions of token arrays: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, CLS, SEP = 0, 101, 102


def repeat(value: int, n: Column, kind: str = "int") -> Column:
    return F.array_repeat(F.lit(value).cast(kind), n.cast("int"))


def mask_after(a: Column, eos: int, pad: int = PAD) -> Column:
    """Everything after the first ``eos`` becomes ``pad``."""
    at = F.array_position(a, eos)
    return F.when(at == 0, a).otherwise(F.transform(a, lambda x, i: F.when(i < at, x).otherwise(F.lit(pad).cast("int"))))


def pad_right(a: Column, length: Column | int, pad: int = PAD) -> Column:
    """``a`` cut or padded to ``length``."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(a, repeat(pad, F.greatest(n - F.size(a), F.lit(0)))), F.lit(1), n)


def pad_left(a: Column, length: int, pad: int = PAD) -> Column:
    """The last ``length`` elements, padded in front."""
    n = F.least(F.size(a), F.lit(length))
    tail = F.slice(a, F.greatest(F.size(a) - length + 1, F.lit(1)), n)
    return F.concat(repeat(pad, F.lit(length) - n), tail)


def up_to_multiple(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def attention_mask(n: Column, length: Column) -> Column:
    """``n`` ones and then zeros, ``length`` in all."""
    return F.concat(repeat(1, n), repeat(0, length - n))


def roll_cls_sep(a: Column, cls: int = CLS, sep: int = SEP, pad: int = PAD) -> Column:
    """``cls`` goes in front, the last element drops out, and the first ``pad`` becomes ``sep``; without a ``pad`` nothing else changes."""
    b = F.concat(F.array(F.lit(cls)), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
    at = F.array_position(b, pad)
    return F.transform(b, lambda x, i: F.when(i + 1 == at, F.lit(sep)).otherwise(x))


def prepend_drop_last(a: Column, start: int = CLS) -> Column:
    return F.concat(F.array(F.lit(start)), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))


def shift_right(a: Column, pad: int = PAD) -> Column:
    return prepend_drop_last(a, pad)


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def used_length(a: Column, pad: int = PAD) -> Column:
    """The length of ``a`` without its trailing pads."""
    return F.coalesce(F.array_max(F.transform(a, lambda x, i: F.when(x != pad, i + 1).otherwise(F.lit(0)))), F.lit(0))


def find_runs(a: Column, run: Column) -> Column:
    """0-based places at which ``run`` occurs in ``a``; none for an empty run."""
    most = F.size(a) - F.size(run)
    places = F.when((F.size(run) > 0) & (most >= 0), F.sequence(F.lit(0), F.greatest(most, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.slice(a, i + 1, F.size(run)) == run)


def chunked(a: Column, width: int) -> Column:
    """``a`` in pieces of ``width``; the last may be shorter."""
    n = F.ceil(F.size(a) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(a, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<array<int>>"))
