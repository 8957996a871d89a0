"""The registered queries: against their SQL, and the pipeline against its stages done apart."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomwalk.llm.oracles import ORACLES

from ..test_queries import TABLES, compare
from . import helpers as H


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    compare(spark, con, name, entry.queries()[name], ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n not in ORACLES])
def test_whole_table(spark, sf_dir, name):
    out = entry.queries()[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.columns[0] == "doc_id"
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    """Every stage against plain Python on what its predecessor kept."""
    import corpus_pipeline as P

    from .test_line_dedup import expected as without_lines

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = {"start": docs}
    at = docs
    for name, stage in P.STAGES:
        stage(spark, at, sf_dir).write.parquet(str(tmp_path / name))
        at = tables[name] = spark.read.parquet(str(tmp_path / name))
        if name != P.STAGES[-1][0]:
            assert sorted(at.columns) == sorted(docs.columns)
    rows = {k: {r.doc_id: r for r in t.collect()} for k, t in tables.items()}
    text = {k: {i: r.text for i, r in t.items()} for k, t in rows.items() if k != "byte_bpe"}

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = set(text["start"]) - set(text["toxicity"])
    assert gone and all(text["toxicity"][i] == text["start"][i] for i in text["toxicity"])
    assert sum((i in gone) == bool(y) for i, y in labels.items()) >= 0.9 * len(labels)

    assert text["line_dedup"] == without_lines(list(text["toxicity"].items()))
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"].values())

    want = H.near_duplicates(list(text["line_dedup"].items()), P.SIMILARITY)
    assert text["near_dedup"] == {i: t for i, t in text["line_dedup"].items() if want[i][1] == i}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = H.contamination(list(text["near_dedup"].items()), items)
    assert text["decontamination"] == {i: t for i, t in text["near_dedup"].items() if not hit[i][1]}

    from .test_bytebpe import LIBRARY

    assert {i: r.ids for i, r in rows["byte_bpe"].items()} == {i: LIBRARY.encode_ordinary(t or "") for i, t in text["decontamination"].items()}
    run = P.run(spark, sf_dir)
    assert sorted((r.doc_id, r.ids_sha256) for r in run.collect()) == sorted((i, r.ids_sha256) for i, r in rows["byte_bpe"].items())
