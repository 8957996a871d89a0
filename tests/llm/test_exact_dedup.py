import hashlib
import re

from pyspark.sql import functions as F

from loomwalk.llm import exact_dedup

from .helpers import documents

ROWS = [(1, "a b c"), (2, "abc"), (3, "a\tb\nc  "), (4, None), (5, ""), (6, " \n"), (7, "abd"), (8, "ébc"), (9, "a  b  c"), (10, "a bc"), (11, "x" * 50_000), (12, "x" * 50_000), (12, "x " * 3)]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {n: (min(g)[1], len(g)) for n, g in groups.items()}


def check(spark, rows, **how):
    out = exact_dedup.exact_dedup(documents(spark, rows), **how).collect()
    want = expected(rows)
    assert len(out) == len(rows)
    by_id = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    for r in out:
        if [i for i, _ in rows].count(r.doc_id) > 1:
            continue
        n = by_id[r.doc_id]
        assert (r.keep_id, r.group_size) == want[n]
        assert r.kept == (r.keep_id == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(n.encode()).hexdigest()


def test_groups_ties_nulls(spark):
    check(spark, ROWS)


def test_hash_collisions_are_told_apart_by_bytes(spark):
    weak = lambda n: F.unhex(F.substring(F.md5(n.cast("binary")), 1, 2))
    one = lambda n: F.unhex(F.lit("00"))
    check(spark, [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(300)], hash_fn=weak)
    check(spark, ROWS[:10], hash_fn=one)


def test_empty_table_and_small_bitmap(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    check(spark, [(i, f"t{i // 2}") for i in range(64)], bitmap_bits=16)
