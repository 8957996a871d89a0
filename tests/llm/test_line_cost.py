"""What line dedup computes for every line stands where it is cheap, and gives what it gave."""

import random

from pyspark.sql import functions as F

from loomwalk.llm import line_dedup as L

from .helpers import documents

RNG = random.Random(33)


def test_no_generator_of_the_first_pass_is_interpreted(spark):
    plan = L._sketched(L._documents(documents(spark, [(1, "a few words\nof two lines")]), "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    made = [x for x in plan.split("\n") if "Generate" in x]
    assert len(made) >= 3 and not any("lambda" in x for x in made)


def test_sketches_and_lines_stay_what_they_are(spark):
    chars = [chr(c) for c in range(1, 0x180) if c != 10] + list("  ー・゛亜한กЖ٣“”€①𝒳𠀀")
    lines = ["".join(RNG.choice(chars) for _ in range(RNG.randint(0, 40))) for _ in range(400)] + ["亜한亜한กЖ亜亜亜 ・ 亜亜", "the the the", " "]
    df = documents(spark, list(enumerate(lines)))
    no = r"[^a-z0-9\xAA\xB5\xBA\xC0-\x{1FFF}\x{2070}-\x{2FFF}\x{3005}-\x{3007}\x{3040}-\x{30FA}\x{30FC}-\x{FEFF}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{10FFFF}]+"
    want = df.select("doc_id", F.trim(F.regexp_replace(F.lower("text"), no, " ")).alias("w"), L.normal_line(F.col("text")).alias("n"))
    assert all(r.w == r.n for r in want.collect())
    want = want.where("w <> ''").select("doc_id", F.unhex(F.md5(F.col("w").cast("binary"))).alias("node"), L.sketch(L.features_of(F.col("w"))).alias("s"))
    got = L._sketched(L._documents(df, "doc_id", "text"))
    found = {r.doc_id: (bytes(r.node), [x for x in (r.s0, r.s1, r.s2, r.s3, r.s4) if x is not None]) for r in got.collect()}
    assert found == {r.doc_id: (bytes(r.node), r.s) for r in want.collect()} and len(found) > 300
