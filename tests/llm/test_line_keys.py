"""Keys of the blocks of a line."""

import re

from pyspark.sql import functions as F

from loomwalk.llm import line_dedup as L


def test_keys_are_made_in_generated_code(spark):
    """A choice with a missing block is no key; ten keys for each line are made without interpreted functions."""
    names = [f"s{i}" for i in range(L.SKETCH)]
    rows = [(0, 1, 2, 3, 4, 5), (1, 1, 2, 3, None, None), (2, 1, 2, None, None, None), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} long" for n in names))
    keys = df.select("id", F.explode(L._keys([F.col(n) for n in names])).alias("bucket")).where("bucket is not null")
    assert re.search(r"\*\(\d+\) Generate explode", keys._jdf.queryExecution().executedPlan().toString())
    got = [(r.id, r.bucket) for r in keys.collect()]
    assert sorted(i for i, _ in got) == [0] * 10 + [1]
    assert [b for i, b in got if i == 1] == [df.where("id = 0").select(F.xxhash64("s0", "s1", "s2")).first()[0]] and len(set(got)) == 11
