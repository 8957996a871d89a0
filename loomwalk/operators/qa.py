"""Question answering: answer spans, metrics, and declarative queries over one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V


def best_spans(logits: DataFrame, *, n_best: int = 20, longest: int = 30) -> DataFrame:
    """(id, feature, start, end, score, rank) of (id, feature, starts, ends): the best answer spans of each example.

    Of each feature the ``n_best`` best starts and ends are combined, unless the end comes first or the span is longer than ``longest``; of
    all spans of an example the ``n_best`` with the largest sum are kept, ties by feature, start, end.  Position 0 stands for no answer and is left out.
    """
    top = lambda c: F.slice(F.array_sort(F.transform(c, lambda x, i: F.struct((-x).alias("l"), i.alias("i"))).cast("array<struct<l:double,i:int>>")), F.lit(1), F.lit(n_best))
    pairs = logits.select("id", "feature", F.explode(top(F.col("starts"))).alias("s"), top(F.col("ends")).alias("es")).select("id", "feature", "s", F.explode("es").alias("e"))
    ok = (F.col("s.i") > 0) & (F.col("e.i") >= F.col("s.i")) & (F.col("e.i") - F.col("s.i") + 1 <= longest)
    spans = pairs.where(ok).select("id", "feature", F.col("s.i").alias("start"), F.col("e.i").alias("end"), F.round(-(F.col("s.l") + F.col("e.l")), 6).alias("score"))
    order = W.partitionBy("id").orderBy(F.col("score").desc(), "feature", "start", "end")
    return spans.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_best)


def null_scores(logits: DataFrame) -> DataFrame:
    """(id, null_score): the least sum at position 0 over the features of an example."""
    return logits.groupBy("id").agg(F.round(F.min(F.col("starts")[0] + F.col("ends")[0]), 6).alias("null_score"))


def answers(logits: DataFrame, *, threshold: float = 0.0, n_best: int = 20, longest: int = 30) -> DataFrame:
    """(id, start, end, probability, null_odds): the best span with its softmax probability among the kept ones and no answer; the places are -1
    where no answer beats the best span by more than ``threshold``."""
    spans = best_spans(logits, n_best=n_best, longest=longest)
    nulls = null_scores(logits)
    top = spans.groupBy("id").agg(F.max_by(F.struct("start", "end", "score"), -F.col("rank")).alias("b"), F.max("score").alias("m"), F.collect_list("score").alias("all"))
    rows = nulls.join(top, "id", "left")
    most = F.greatest(F.col("m"), F.col("null_score"))
    mass = V.total(F.transform("all", lambda x: F.exp(x - most))) + F.exp(F.col("null_score") - most)
    odds = F.col("null_score") - F.col("b.score")
    none = F.coalesce(odds > threshold, F.lit(True))
    return rows.select("id", F.when(none, -1).otherwise(F.col("b.start")).alias("start"), F.when(none, -1).otherwise(F.col("b.end")).alias("end"), F.round(F.exp(F.col("b.score") - most) / mass, 6).alias("probability"), F.round(odds, 6).alias("null_odds"))


def beam_answers(beams: DataFrame, *, start_n: int, end_n: int, longest: int = 30, n_best: int = 20) -> DataFrame:
    """(id, start, end, score, rank) of (id, start_score, start_index, end_score, end_index): the beam's ends of start i lie at ``i * end_n + j``."""
    i = F.explode(F.sequence(F.lit(0), F.lit(start_n - 1))).alias("i")
    grid = beams.select("*", i).select("*", F.explode(F.sequence(F.lit(0), F.lit(end_n - 1))).alias("j"))
    at = F.col("i") * end_n + F.col("j")
    s, e = F.get("start_index", F.col("i")), F.get("end_index", at)
    spans = grid.select("id", s.alias("start"), e.alias("end"), F.round(F.get("start_score", F.col("i")) + F.get("end_score", at), 6).alias("score"))
    ok = spans.where((F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") + 1 <= longest))
    order = W.partitionBy("id").orderBy(F.col("score").desc(), "start", "end")
    return ok.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_best)


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the multisets of normalised words; 0 without a common word."""
    p, r = X.split_squeezed(X.normal_answer(prediction)), X.split_squeezed(X.normal_answer(reference))
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(r, w)))
    return F.when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (F.size(p) + F.size(r)))


def exact_match(prediction: Column, reference: Column) -> Column:
    return (X.normal_answer(prediction) == X.normal_answer(reference)).cast("int")


def best_over_references(rows: DataFrame, metric: Column, *, id_col: str = "id") -> DataFrame:
    """(id, best): the largest value of ``metric`` over the references of each question."""
    return rows.groupBy(id_col).agg(F.max(metric).alias("best"))


def precision_at(found: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(found, F.lit(1), F.lit(k)), relevant)) / F.lit(k)


def multiset_counts(rows: DataFrame, *, id_col: str, tokens_col: str, n: int) -> DataFrame:
    """(id, gram, c): the n-grams of a token list with their counts."""
    most = F.size(tokens_col) - n
    grams = F.when(most >= 0, F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda i: F.array_join(F.slice(tokens_col, i + 1, F.lit(n)), " ")))
    return rows.select(F.col(id_col).alias("id"), F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count(F.lit(1)).alias("c"))


def rouge_n(pairs: DataFrame, n: int = 1) -> DataFrame:
    """(id, precision, recall, f1) of the n-gram overlap of (id, prediction, reference) token lists."""
    p, r = multiset_counts(pairs, id_col="id", tokens_col="prediction", n=n), multiset_counts(pairs, id_col="id", tokens_col="reference", n=n)
    both = p.join(r.withColumnRenamed("c", "cr"), ["id", "gram"]).groupBy("id").agg(F.sum(F.least("c", "cr")).alias("hit"))
    size = pairs.select("id", F.greatest(F.size("prediction") - n + 1, F.lit(0)).alias("np"), F.greatest(F.size("reference") - n + 1, F.lit(0)).alias("nr"))
    out = size.join(both, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select("id", F.round(ratio(F.col("hit"), F.col("np")), 6).alias("precision"), F.round(ratio(F.col("hit"), F.col("nr")), 6).alias("recall"), F.round(ratio(2 * F.col("hit"), F.col("np") + F.col("nr")), 6).alias("f1"))


# --- one table -------------------------------------------------------------------------------------------------
COMPARE = ["=", ">", "<"]
AGGREGATES = ["", "max", "min", "count", "sum", "avg"]


def table_query(table: DataFrame, *, select: str, conditions: list[tuple[str, str, object]] = (), aggregate: str = "", tie: list[str] | None = None) -> DataFrame:
    """Selects a column under conditions that all hold (``=``, ``>``, ``<``), with at most one aggregate: (value), or rows of (value) in the order of ``tie``.

    Texts are equal when their lower-cased, squeezed words are.  Of equal extremes the row that ``tie`` puts last (max) or first (min) counts."""
    out = table
    for column, op, value in conditions:
        c = F.col(column)
        if op == "=" and isinstance(value, str):
            out = out.where(X.squeeze(F.lower(c.cast("string"))) == X.squeeze(F.lower(F.lit(value))))
        elif op in COMPARE:
            out = out.where({"=": c == value, ">": c > value, "<": c < value}[op])
        else:
            raise ValueError(f"unknown comparison {op}")
    c = F.col(select)
    if aggregate == "":
        return out.select(*(tie or []), c.alias("value"))
    if aggregate in ("max", "min") and tie:
        pick = F.max_by if aggregate == "max" else F.min_by
        key = F.struct(c, *[F.col(t) for t in tie])
        return out.where(c.isNotNull()).agg(pick(F.struct(c.alias("value"), *[F.col(t) for t in tie]), key).alias("x")).select("x.*")
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate {aggregate}")
    return out.agg({"max": F.max, "min": F.min, "count": F.count, "sum": F.sum, "avg": F.avg}[aggregate](c).alias("value"))


def cell_answers(cells: DataFrame, picks: DataFrame) -> DataFrame:
    """(id, answer) of cells (row, col, value) and picks (id, aggregator, row, col): cell values by place, with the aggregator in front unless it is NONE."""
    rows = picks.join(cells, ["row", "col"]).groupBy("id", "aggregator").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda x: x["value"]), ", ").alias("v"))
    return rows.select("id", F.when(F.col("aggregator") == "NONE", F.col("v")).otherwise(F.concat(F.col("aggregator"), F.lit(" > "), F.col("v"))).alias("answer"))


def parse_table(rows: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, row, col, name, value) of texts whose lines are rows and whose ``#`` separate cells; the first line names the columns."""
    lines = rows.select(F.col(id_col).alias("id"), F.split(F.trim(F.col(text_col)), "\n").alias("l"))
    cells = lines.select("id", F.split(F.col("l")[0], "#").alias("names"), F.posexplode("l").alias("row", "line")).where("row > 0")
    flat = cells.select("id", (F.col("row") - 1).alias("row"), "names", F.posexplode(F.split("line", "#")).alias("col", "value"))
    return flat.select("id", "row", "col", F.get("names", F.col("col")).alias("name"), "value")
