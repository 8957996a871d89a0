"""Readers, writers and streams on small files."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException

from loomwalk.operators import embed as E
from loomwalk.sources import readers as R
from loomwalk.sources import writers as W
from loomwalk.streaming import streams as S


def test_sharded_corpus(spark, tmp_path):
    for k, texts in enumerate([["a", "b"], ["c"], ["d", "e\nf"]]):
        (tmp_path / f"web.chunk.{k:02}.jsonl").write_text("".join(json.dumps({"text": t, "other": 1}) + "\n" for t in texts))
    (tmp_path / "else.chunk.00.jsonl").write_text(json.dumps({"text": "no"}) + "\n")
    rows = R.documents(spark, str(tmp_path), "web").orderBy("doc_id").collect()
    assert [(r.doc_id, r.file_id, r.pos, r.text) for r in rows] == [(0, 0, 0, "a"), (1, 0, 1, "b"), (2, 1, 0, "c"), (3, 2, 0, "d"), (4, 2, 1, "e\nf")]
    plain = R.jsonl(spark, str(tmp_path), pattern="else*").collect()
    assert [(r.file, r.text) for r in plain] == [("else.chunk.00.jsonl", "no")]


def test_arrays(spark, tmp_path):
    np.arange(6, dtype=np.int32).tofile(tmp_path / "a.bin")
    rows = R.binary_arrays(spark, str(tmp_path), "int32", 3).orderBy("row").collect()
    assert [(r.file, r.row, r["values"]) for r in rows] == [("a.bin", 0, [0, 1, 2]), ("a.bin", 1, [3, 4, 5])]
    with pytest.raises(PySparkException):
        R.binary_arrays(spark, str(tmp_path), "int32", 4).collect()
    knn = tmp_path / "knn"
    knn.mkdir()
    np.array([[0, 1], [1, -1]], np.int64).tofile(knn / "I0000000010_x.npy")
    assert sorted((r.q, r["rank"], r.n) for r in R.knn_shards(spark, str(knn), 2).collect()) == [(10, 0, 0), (10, 1, 1), (11, 0, 1)]
    saved = tmp_path / "saved"
    saved.mkdir()
    want = np.arange(21, dtype=np.int64).reshape(7, 3)
    np.save(saved / "I0000000100_x.npy", want)
    np.save(saved / "f.npy", want.astype(np.float32))
    assert sorted((r.q, r["rank"], r.n) for r in R.knn_shards(spark, str(saved), 99).collect()) == [(100 + i, j, 3 * i + j) for i in range(7) for j in range(3)]
    rows = R.binary_arrays(spark, str(saved), "float32", 99, pattern="f*", range_rows=2).orderBy("row").collect()
    assert [r["values"] for r in rows] == want.astype(float).tolist() and [r.row for r in rows] == list(range(7))
    flat = spark.createDataFrame([(i, i * i) for i in range(6)], "pos long, value long")
    assert {r.row: r["values"] for r in R.reshape(flat, 2).collect()} == {0: [0, 1], 1: [4, 9], 2: [16, 25]}
    with pytest.raises(ValueError):
        R.reshape(flat, 4)


def test_small_formats(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('A "title"\tsome text\nB\tmore\n')
    assert [tuple(r) for r in R.titled(spark, str(tmp_path / "t.tsv")).collect()] == [('A "title"', "some text"), ("B", "more")]
    (tmp_path / "x.conll").write_text("-DOCSTART- O\n\nEU B-ORG\nrejects O\n\ncall\n")
    rows = R.conll(spark, str(tmp_path / "x.conll")).orderBy("pos").collect()
    assert [(r.word, r.label) for r in rows] == [("EU", "B-ORG"), ("rejects", "O"), ("call", "O")]
    assert rows[0].record == rows[1].record != rows[2].record
    (tmp_path / "shard-00-17.tfrecord").write_bytes(b"x")
    assert [(r.file, r.n) for r in R.counted_shards(spark, str(tmp_path)).collect()] == [("shard-00-17.tfrecord", 17)]
    rel = spark.createDataFrame([("q", [("t1",), ("t2",)])], "question string, positive_ctxs array<struct<title:string>>")
    assert R.relevance(rel).first().titles == "t1\tt2"
    (tmp_path / "one.txt").write_text("a\nb")
    assert R.whole_texts(spark, str(tmp_path), "one.txt").first().text == "a\nb"


def test_ordered_shards(spark, tmp_path):
    d = spark.range(10).selectExpr("id as out_pos", "cast(9 - id as string) as text")
    W.ordered_shards(d, str(tmp_path / "o"), 3)
    got = {}
    for p in sorted((tmp_path / "o").glob("slice=*/*.json")):
        got.setdefault(p.parent.name, []).extend(json.loads(x)["out_pos"] for x in p.read_text().splitlines())
    assert got == {"slice=0": [0, 1, 2], "slice=1": [3, 4, 5], "slice=2": [6, 7, 8], "slice=3": [9]}


def test_other_writers(spark, tmp_path):
    d = spark.range(0, 10, 1, 1).selectExpr("id", "id as pos")
    W.json_batches(d, str(tmp_path / "j"), rows=4)
    assert len(list((tmp_path / "j").glob("*.json.gz"))) == 3
    W.record_shards(d, str(tmp_path / "r"), 4)
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("shard").count().count() == 3
    W.statistics(d.groupBy().count(), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["count"] == 10
    with pytest.raises(ValueError):
        W.capacity(d, 9)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [(f"2024-01-01 00:0{i}:00", t) for i, t in enumerate(["a b", "ab", "c", "c"])]
    (src / "x.json").write_text("".join(json.dumps({"ts": a, "text": t}) + "\n" for a, t in rows))
    stream = S.jsonl_stream(spark, str(src), "ts timestamp, text string")
    seen = []
    q = S.for_each_batch(S.dedup_stream(stream, time_col="ts"), lambda df, _: seen.extend(r.text for r in df.collect()), str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert len(seen) == 2 and {t.replace(" ", "") for t in seen} == {"ab", "c"}
    batch = spark.createDataFrame([(datetime(2024, 1, 1), "k"), (datetime(2024, 1, 1, 0, 5), "k"), (datetime(2024, 1, 1, 1), "k")], "ts timestamp, key string")
    assert sorted(r.n for r in S.windowed_counts(batch, time_col="ts", key_col="key").collect()) == [1, 2]
    late = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 9)), (datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 11))], "expected timestamp, arrived timestamp")
    assert S.on_time(late, expected_col="expected", arrived_col="arrived", delta="1 SECOND").count() == 1


def test_embedding_and_pooling(spark):
    d = spark.createDataFrame([(0, "hello"), (1, None), (2, "hello")], "doc_id long, text string")
    out = {r.vec_id: r.embedding for r in E.embed(d, lambda: E.hashed_ngrams(8), key="h8").collect()}
    assert out[0] == out[2] and sum(x * x for x in out[0]) == pytest.approx(1, abs=1e-5) and set(out[1]) == {0.0}
    tokens = spark.createDataFrame([(0, [7, 1, 2, 0])], "doc_id long, tokens array<int>")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (7, [9.0, 9.0])], "token int, v array<float>")
    assert E.mean_pool(tokens, vectors).first().embedding == pytest.approx([2.0, 4.0])
    assert E.first_place(tokens, vectors).first().embedding == [9.0, 9.0]
