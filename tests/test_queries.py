"""The registered queries against their SQL, in the way the rows are compared by sorted columns; and what may be missing."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from loomwalk import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, duck, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = df.toPandas()
    cursor = duck.execute(sql)
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    want = cursor.df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), (name, c)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_and_sql(spark, duck, sf_dir, name):
    compare(spark, duck, name, entry.queries()[name], plans.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_queries_without_sql(spark, sf_dir, name):
    rows = entry.queries()[name](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    want = {"near_dup_extremes": docs, "wordpiece": docs, "token_budget_batches": docs, "merged_clusters": vectors, "ivf_knn_recall": 1, "ivf_pq_recall": 1}
    assert rows.count() == want[name]
    if name in ("ivf_knn_recall", "ivf_pq_recall"):
        assert rows.first().recall >= 0.9
    if name == "merged_clusters":
        assert rows.select("doc_id").distinct().count() == vectors


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["step", "doc_id", "cluster_id"]


def test_without_the_training_data_subpackage(tmp_path):
    """The rest imports and registers when the subpackage and the pipeline are gone."""
    root = Path(entry.__file__).resolve().parent
    for p in root.iterdir():
        if p.name not in ("loomwalk", "corpus_pipeline.py", ".git", "tests"):
            os.symlink(p, tmp_path / p.name)
    (tmp_path / "loomwalk").mkdir()
    for p in (root / "loomwalk").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "loomwalk" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; print(len(q))"
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(plans.QUERIES)
