from pyspark.sql import functions as F

from loomwalk.llm import toxicity

from .helpers import documents


def test_a_text_that_does_not_fit_is_skipped(spark, monkeypatch):
    ids = spark.range(60).where(~toxicity.held_out("id")).orderBy(F.xxhash64("id"), "id")
    ids = [r.id for r in ids.collect()]
    rows = [(i, "long " * 1000 if k == 0 else f"text {i}") for k, i in enumerate(ids)] + [(ids[0], "a short text of the same id")]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    seen, count = toxicity.training_rows(documents(spark, rows), labels)
    assert sorted((r.id, r.t, r.y) for r in seen.collect()) == [(i, t, i % 2) for i, t in sorted(rows) if len(t) < 2000]
    assert count == {y: sum(i % 2 == y for i in ids) for y in (0, 1)}


def test_no_text_fits(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1)
    docs, labels = documents(spark, [(1, "some text"), (2, "more text")]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels)[0].count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {0}
