"""Licence recognition by sentences and ordered rules; DataFrame functions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import COMMENT, CUE, RULES, SENTENCES, SPLIT, STOP, normal, pattern, wrapped


def pieces_of(sentence: str) -> list[str]:
    """A known sentence as the scanner sees it: cut where the scanner cuts a text."""
    import re

    return [p for p in map(normal, re.split(SPLIT, sentence)) if p]


def known_pieces() -> dict[str, str]:
    """Normalised piece -> identifier.  A sentence is named by the first of its pieces that no other identifier's sentences have; its other pieces name nothing."""
    cut = [(ident, pieces_of(sentence)) for ident, sentence in SENTENCES]
    owners: dict[str, set[str]] = {}
    for ident, pieces in cut:
        for p in pieces:
            owners.setdefault(p, set()).add(ident)
    table = dict.fromkeys(owners, "")
    for ident, pieces in cut:
        table[next(p for p in pieces if len(owners[p]) == 1)] = ident
    return table


def _normal(text: Column) -> Column:
    """The lower-cased text of words, with one space, line end or "|" (for a STOP) between two of them."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), COMMENT, "")
    marked = F.regexp_replace(lines, STOP, "|")
    plain = F.regexp_replace(F.lower(marked), r"[^a-z0-9\n|]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r" ?([\n|])[ \n|]*", "$1"), "^ | $", "")


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_known, sentence_ids, licenses, status).

    The text is normalised, and known licence sentences that fill whole lines or sentences of it, wrapped or not, are mapped to their identifiers;
    ``sentence_ids`` joins the identifiers in text order.  The ordered rules then run over that sequence: each rule that
    matches names its licence and consumes what it matched.  ``licenses`` joins the distinct names, sorted; ``status`` is
    ``none`` (no known sentence), ``matched`` (every sentence consumed) or ``partial`` (some are left).

    Null, empty and cue-less texts have status ``none``.  Rows are independent: repeated rows, null ids, long texts and extra
    columns need no rule.  One scan, no shuffle; both tables are constants in the plan.
    """
    known = {k: v for k, v in known_pieces().items() if v}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    sentences = F.regexp_extract_all(_normal(F.col("t")), F.lit(wrapped(list(known))), F.lit(0))
    named = F.transform(sentences, lambda s: F.element_at(table, F.translate(s, "\n", " ")))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ids = base.select("doc_id", F.when(F.col("t").rlike(CUE), named).otherwise(F.array().cast("array<string>")).alias("ids"))
    seq = F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern(rule)).alias("pattern")) for name, rule in RULES])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.regexp_like(acc["seq"], rule["pattern"])
        found = F.when(hit, F.array_append(acc["found"], rule["name"])).otherwise(acc["found"])
        return F.struct(F.when(hit, F.regexp_replace(acc["seq"], rule["pattern"], "")).otherwise(acc["seq"]).alias("seq"), found.alias("found"))

    start = F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("found"))
    done = F.when(F.size("ids") > 0, F.aggregate(rules, start, step))
    out = ids.select("doc_id", "ids", done.alias("r"))
    status = F.when(F.size("ids") == 0, "none").when(F.col("r.seq") == "", "matched").otherwise("partial")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("r.found")), ","), F.lit("")).alias("licenses"),
        status.alias("status"),
    )
