from loomwalk.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n long, p1 string, keep long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def expected(rows):
    convs = {}
    for c, t, role, text in set(rows):
        convs.setdefault(c, []).append(((t is not None, t or 0), (role is not None, role or ""), text is not None, text or "", role, text))
    seqs = {c: tuple((x[4], x[5]) for x in sorted(v, key=lambda x: x[:4])) for c, v in convs.items()}
    out = {}
    for s in set(seqs.values()):
        if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            ids = [c for c, o in seqs.items() if o == s]
            low = min(ids, key=lambda c: (c is not None, c or 0)) if None not in ids else min((i for i in ids if i is not None), default=None)
            out[low] = (len(s), len(ids), "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in s))
    return out


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"),  # a snapshot of 1
    (3, 0, "user", "hi"),  # and one of that
    (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
    (5, 0, "user", "hi"), (5, 1, "assistant", "other"),  # the same as 4
    (6, 0, "user", "hello"), (7, 0, None, None), (8, 0, "user", ""), (8, 0, "user", ""), (9, 5, "user", "late"), (9, 9, "user", "x" * 20_000),
]


def got(spark, rows):
    return {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.collapse_and_render(turns(spark, rows)).collect()}


def test_maximal_conversations(spark):
    out = got(spark, ROWS)
    assert out == expected(ROWS)
    assert set(out) == {1, 4, 6, 7, 8, 9} and out[4][1] == 2


def test_many_snapshots_of_long_conversations(spark):
    rows = [(100 * g + n, t, "user" if t % 2 == 0 else "assistant", f"g{g % 3} t{t}") for g in range(6) for n in range(1, 8) for t in range(n)]
    assert got(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert got(spark, []) == {}


def test_null_conversation(spark):
    out = got(spark, [(None, 0, "user", "a"), (None, 1, "user", "b"), (3, 0, "user", "a")])
    assert out == {None: (2, 1, "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n")}


def test_no_python_in_the_plan(spark):
    plan = chat.collapse_and_render(turns(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
