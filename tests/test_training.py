"""Chunks, neighbours, packs, windows, duplicates: goldens and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loomwalk.operators import batching as B
from loomwalk.operators import chunking as C
from loomwalk.operators import dedup as D
from loomwalk.operators import neighbors as N
from loomwalk.operators import qa as Q
from loomwalk.operators import quality as G
from loomwalk.operators import tokens as TK
from loomwalk.storage import numbered, running_sum


def docs(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<int>")


def test_chunk_goldens(spark):
    want = {1: [([1, 0, 0, 0], 0)], 4: [([1, 2, 3, 4], 0)], 5: [([1, 2, 3, 4], 5), ([5, 0, 0, 0], 0)], 9: [([1, 2, 3, 4], 5), ([5, 6, 7, 8], 9), ([9, 0, 0, 0], 0)]}
    for n, chunks in want.items():
        rows = C.doc_chunks(docs(spark, [list(range(1, n + 1))]), chunk=4).orderBy("chunk_ix").collect()
        assert [(r.tokens, r.next_token) for r in rows] == chunks


def test_empty_documents_have_no_chunks(spark):
    d = docs(spark, [[1, 2], [], [3] * 5])
    rows = C.corpus_chunks(d, chunk=2).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.doc_id) for r in rows] == [(0, 0), (1, 2), (2, 2), (3, 2)]
    assert [r.begin_chunk for r in C.sequence_starts(d, chunk=2, sequence=4).orderBy("begin_chunk").collect()] == [0, 1, 3]
    with pytest.raises(ValueError):
        C.sequence_starts(d, chunk=2, sequence=5)


def test_training_example_golden(spark):
    chunks = spark.createDataFrame([(0, 0, [1, 2], 3), (1, 0, [3, 10], 5), (2, 1, [5, 6], 10), (3, 1, [10, 0], 0)], "chunk_id long, doc_id long, tokens array<int>, next_token int")
    knn = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 2)], "q long, rank int, n long")
    starts = spark.createDataFrame([(0,), (2,)], "begin_chunk long")
    out = {r.begin_chunk: r for r in N.examples(starts, chunks, knn, 2, per_sequence=2, chunk=2, eos=10).collect()}
    assert out[0].tokens == [1, 2, 3, 10, 0]
    assert out[0].retrieved == [[[3, 10, 0, 0], [5, 6, 10, 0]], [[5, 6, 10, 0], [0, 0, 0, 0]]]
    assert out[2].tokens == [5, 6, 10, 0, 0] and out[2].retrieved == [[[0] * 4] * 2] * 2


def test_neighbours_outside_of_the_document(spark):
    chunks = spark.createDataFrame([(0, 0, [1]), (1, 0, [2]), (2, 1, [3]), (3, 1, [4])], "chunk_id long, doc_id long, tokens array<int>")
    knn = spark.createDataFrame([(0, 1, 1), (0, 2, 3), (0, 3, 2)], "q long, rank int, n long")
    kept = N.keep_foreign(knn, chunks, 1)
    assert [(r["rank"], r.n) for r in kept.collect()] == [(1, 3)]
    assert N.keep_foreign(knn, chunks, 1, mask=False).first().n == 1
    (row,) = N.neighbour_tokens(N.keep_foreign(knn, chunks, 2), chunks, chunk=1).where("neighbour_id = 2").collect()
    assert (row.neighbour, row.continuation) == ([3], [4])
    (row,) = N.neighbour_tokens(kept, chunks, chunk=1).collect()
    assert (row.neighbour, row.continuation) == ([4], [0])
    out = {r.chunk_id: r.retrieved for r in N.retrieved_blocks(kept, chunks, 2, chunk=1).collect()}
    assert out[0] == [[4, 0], [0, 0]] and out[3] == [[0, 0], [0, 0]]


@pytest.mark.parametrize("length", [3, 5, 100])
def test_packing_against_a_stream(spark, length):
    rng = random.Random(length)
    lists = [[rng.randrange(1, 50) for _ in range(rng.randrange(0, 12))] for _ in range(40)]
    stream = [x for a in lists for x in [*a, 99]]
    out = C.pack_constant(docs(spark, lists), length=length, separator=99).orderBy("pack").collect()
    assert [r.tokens for r in out] == [stream[i : i + length] for i in range(0, len(stream) - length + 1, length)]


def test_strided_windows(spark):
    rows = spark.createDataFrame([(0, list(range(100, 120)), [1, 2], 9, 10), (1, [5, 6], [1, 2], 0, 1)], "doc_id long, tokens array<int>, question array<int>, answer_start int, answer_end int")
    out = C.strided_windows(rows, most=10, stride=2).orderBy("doc_id", "window_ix").collect()
    first = [r for r in out if r.doc_id == 0]
    assert [r.begin for r in first] == [0, 6, 12] and first[1].tokens == [1, 2, *range(106, 114)]
    assert [(r.start, r.end) for r in first] == [(-100, -100)] * 3  # outside of the first window, and so of all later ones
    assert [(r.start, r.end, r.tokens) for r in out if r.doc_id == 1] == [(2, 3, [1, 2, 5, 6])]


def test_overlapping_chunks(spark):
    got = lambda n: [(r.begin, r.size, r.left, r.right) for r in C.overlapping_chunks(spark.createDataFrame([(0, n)], "doc_id long, n long"), length=10, left=2, right=2).orderBy("begin").collect()]
    assert got(10) == [(0, 10, 0, 0)]
    assert got(16) == [(0, 10, 0, 2), (6, 10, 2, 0)]
    assert got(3) == [(0, 3, 0, 0)] and got(0) == []
    with pytest.raises(ValueError):
        C.overlapping_chunks(spark.createDataFrame([(0, 1)], "doc_id long, n long"), length=4, left=2, right=2)


def test_ordered_packs(spark):
    rows = spark.createDataFrame([(0, 0, "a", "A", 3, 1), (0, 1, "b", "B", 3, 1), (0, 2, "c", "C", 6, 1), (1, 0, "d", "D", 1, 1)], "group long, pos long, source string, target string, n_source int, n_target int")
    out = [tuple(r) for r in C.pack_pairs(rows, most=6).orderBy("group", "pack").collect()]
    assert out == [(0, 0, "a b", "A B"), (0, 1, "c", "C"), (1, 0, "d", "D")]
    lines = spark.createDataFrame([(0, 0, "x", 2), (0, 1, "y", 2), (0, 2, "", 0), (0, 3, "z", 2), (0, 4, "", 0), (0, 5, "", 0), (0, 6, "w", 3)], "group long, pos long, line string, n_tokens int")
    assert [(r.pos, r.record) for r in C.split_records(lines, most=3).orderBy("pos").collect()] == [(0, 0), (1, 1), (3, 2), (6, 3)]
    b = spark.createDataFrame([(0, 0, 5), (1, 0, 4), (2, 0, 1), (3, 0, 1)], "id long, g long, n long")
    assert [(r.id, r.batch) for r in B.token_budget_batches(b, id_col="id", length_col="n", budget=10, group_col="g").orderBy("id").collect()] == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_adjacent_duplicates_compare_with_the_last_kept(spark):
    a = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789z0y1x2w3v4u5t6s7r8q9pAoBnCmDlEkFjGiHhI"[:100]
    b = a[:95] + "!@$%^"
    c = "&*()-" + b[5:]
    rows = spark.createDataFrame([(0, 0, 0, a), (1, 0, 1, b), (2, 0, 2, c), (3, 1, 3, c), (4, 1, 4, None), (5, 1, 5, ""), (6, 1, 6, "")], "doc_id long, slice long, out_pos long, text string")
    keep = {r.doc_id: r.keep for r in D.adjacent_dedup(rows).collect()}
    assert keep == {0: True, 1: False, 2: True, 3: True, 5: True, 6: False}


def test_near_duplicate_golden(spark):
    d = spark.createDataFrame([(0, "a " * 20), (1, "a " * 30), (2, "b " * 7)], "doc_id long, text string")
    out = {r.doc_id: (r.extreme_id, r.is_extreme, r.copies) for r in D.extremes(d).collect()}
    assert out == {0: (0, True, 2), 1: (0, False, 2), 2: (2, True, 1)}


def test_similar_pairs_and_extremes_by_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(80)}" for _ in range(30)] for _ in range(6)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(9)}" for w in base[i % 6])) for i in range(60)]
    sets = {i: frozenset(t.split()) for i, t in rows}
    classes = {}
    for i, s in sets.items():
        classes.setdefault(s, i)
    alike = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.a, r.b) for r in D.similar_pairs(D.token_sets(d)[0]).collect()}
    assert got == {(i, j) for s, i in classes.items() for t, j in classes.items() if i < j and alike(s, t)}
    heads, want = [], {}
    for i, s in sets.items():
        want[i] = next((h for h in heads if alike(sets[h], s)), i)
        if want[i] == i:
            heads.append(i)
    assert {r.doc_id: r.extreme_id for r in D.extremes(d).collect()} == want


def test_word_pieces(spark):
    vocab = "[UNK] [CLS] [SEP] [PAD] [MASK] want ##want ##ed wa un runn ##ing , low lowest".split()
    assert TK.pieces("unwanted", vocab) == ["un", "##want", "##ed"] and TK.pieces("unwantedX", vocab) == ["[UNK]"] and TK.pieces("x" * 101, vocab) == ["[UNK]"]
    d = spark.createDataFrame([(0, "UNwantéd,running"), (1, "")], "id long, t string")
    from loomwalk.functions import text as X

    p = d.select("id", TK.wordpiece(X.basic_tokens(F.col("t")), vocab, spark).alias("pieces"))
    out = {r.id: r.pieces for r in p.collect()}
    assert out == {0: ["un", "##want", "##ed", ",", "runn", "##ing"], 1: []}
    named = p.withColumnRenamed("id", "doc_id")
    v = spark.createDataFrame(list(enumerate(vocab)), "id long, token string")
    assert TK.to_ids(named, v, key="doc_id", unknown=0).first().ids == [9, 6, 7, 12, 10, 11]
    assert p.select(TK.to_text(F.col("pieces"))).where("id = 0").first()[0] == "unwanted , running"


def test_special_tokens_and_word_labels(spark):
    one = spark.createDataFrame([([7, 8], [9])], "a array<int>, b array<int>")
    i, t, m = TK.with_specials(F.col("a"), F.col("b"))
    assert tuple(one.select(i, t, m).first()) == ([101, 7, 8, 102, 9, 102], [0, 0, 0, 0, 1, 1], [1, 0, 0, 1, 0, 1])
    rows = spark.createDataFrame([(0, [[5, 6], [7]], [1, 2])], "doc_id long, pieces array<array<int>>, labels array<int>")
    r = TK.word_labels(rows, most=10).first()
    assert r.ids == [101, 5, 6, 7, 102] and r.labels == [-100, 1, -100, 2, -100]
    refs = spark.createDataFrame([(list("abcab"),)], "w array<string>").select(TK.mask_references(F.col("w"), ["ab", "abc"], spark)).first()[0]
    assert refs == [1, 2, 4]


def test_answers(spark):
    rows = spark.createDataFrame([(0, 0, [0.0, 3.0, 1.0], [0.0, 1.0, 2.0]), (1, 0, [9.0, 1.0, 0.0], [9.0, 0.0, 1.0])], "id long, feature int, starts array<double>, ends array<double>")
    spans = Q.best_spans(rows, n_best=2).where("id = 0").orderBy("rank").collect()
    assert [(r.start, r.end, r.score) for r in spans] == [(1, 2, 5.0), (1, 1, 4.0)]
    out = {r.id: (r.start, r.end) for r in Q.answers(rows).collect()}
    assert out == {0: (1, 2), 1: (-1, -1)}
    beams = spark.createDataFrame([(0, [2.0, 1.0], [5, 7], [1.0, 0.5, 3.0, 0.0], [6, 4, 9, 7])], "id long, start_score array<double>, start_index array<int>, end_score array<double>, end_index array<int>")
    assert [(r.start, r.end, r.score) for r in Q.beam_answers(beams, start_n=2, end_n=2).orderBy("rank").collect()] == [(7, 9, 4.0), (5, 6, 3.0), (7, 7, 1.0)]


def test_table_query(spark):
    t = spark.createDataFrame([(0, "New York", 5.0), (1, "new  york", 9.0), (2, "Rome", 9.0)], "i long, city string, x double")
    assert Q.table_query(t, select="x", conditions=[("city", "=", "NEW YORK")], aggregate="sum").first().value == 14.0
    assert Q.table_query(t, select="x", aggregate="max", tie=["i"]).first().i == 2
    assert Q.table_query(t, select="x", conditions=[("x", ">", 6), ("i", "<", 2)], aggregate="count").first().value == 1
    with pytest.raises(ValueError):
        Q.table_query(t, select="x", aggregate="median")


def test_global_numbers(spark):
    d = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") % 13).alias("k"))
    out = numbered(d, "k", "id").orderBy("pos").collect()
    assert [(r.k, r.id) for r in out] == sorted((i % 13, i) for i in range(1000)) and [r.pos for r in out] == list(range(1000))
    sums = running_sum(d, F.col("id"), "id").orderBy("id").collect()
    assert [r.before for r in sums] == [i * (i - 1) // 2 for i in range(1000)]
    assert numbered(d.where("id < 0"), "id").count() == 0


def test_guards(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        spark.range(3).select(G.require(F.col("id") < 2, "too large")).collect()
    doc = spark.createDataFrame([("myid", ("f",)), (None, ("f",))], "id string, meta struct<filename: string>")
    assert [r.doc_name for r in G.metadata_id(doc).collect()] == ["myid", "f"]
    with pytest.raises(PySparkException):
        G.metadata_id(spark.createDataFrame([(None, (None,))], "id string, meta struct<filename: string>")).collect()
