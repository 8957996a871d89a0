import hashlib
import random

from loomwalk.llm import decontaminate

from .helpers import contamination, documents

RNG = random.Random(9)
VOCAB = [f"w{i}" for i in range(60)] + ["é", "你好", "the"]


def item(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def tables():
    items = [(i, item(n)) for i, n in enumerate([30, 10, 11, 9, 4, 1, 25, 40])]
    items += [(20, None), (21, ""), (22, "..."), (23, items[0][1].upper()), (3, items[3][1]), (24, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for k in range(40):
        t = item(RNG.randint(0, 60))
        if k % 3 == 0:
            w = items[k % 8][1].split(" ")
            a = RNG.randrange(max(1, len(w) - 9))
            t += ", " + "-".join(w[a : a + 10]) + ". " + item(5)
        docs.append((k, t))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, "w1 " * 300), (104, item(30_000)), (105, "W1!w1?w1 " * 4), (102, items[0][1])]
    return docs, items


def check(spark, docs, items, **how):
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_windows(documents(spark, docs), bench, **how).collect()
    want = contamination(docs, items)
    assert len(out) == len(docs)
    for r in out:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.hit_words, r.item_ids) == (n, sorted(hit), sorted(found))


def test_windows_against_brute_force(spark):
    check(spark, *tables())


def test_benchmark_in_several_tables(spark):
    docs, items = tables()
    check(spark, docs, items, table_bytes=400)


def test_report_and_clean(spark):
    docs, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(docs, items)
    for r in decontaminate.contamination_report(documents(spark, docs), bench).collect():
        n, hit, found = want[r.doc_id]
        ids = ",".join(sorted(map(str, found)))
        assert (r.n_hit, r.n_items, r.contaminated) == (len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    left = decontaminate.clean(documents(spark, docs), bench)
    assert left.columns == documents(spark, []).columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, hit, _) in want.items() if not hit}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [(1, "a b c"), (2, None)])
    assert [r.hit_words for r in decontaminate.find_windows(docs, none).collect()] == [[], []]
    assert decontaminate.find_windows(documents(spark, []), none).count() == 0
