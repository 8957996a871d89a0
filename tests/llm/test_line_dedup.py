"""Line dedup against edit similarity of all pairs of lines, by plain Python that knows neither sketches nor anchors."""

import random
import re

from pyspark.sql import functions as F

from loomwalk.llm import line_dedup as L

from .helpers import components, documents

RNG = random.Random(21)
VOCAB = ["".join(RNG.choice("abcdefghijklmnopé") for _ in range(RNG.randint(2, 11))) for _ in range(400)]


def lines_of(text):
    return re.findall(r"[^\n]+\n?|\n", text or "")


def normal(line):
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def distance(a, b):
    """Edit distance, by columns of bits."""
    if not a or not b:
        return max(len(a), len(b))
    at = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, d = full, 0, len(a)
    for y in b:
        eq = at.get(y, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diag | up) & full, up & diag
        d += bool(right & last) - bool(left & last)
        right = right << 1 | 1
        up, down = (left << 1 | ~(diag | right)) & full, right & diag & full
    return d


def alike(a, b):
    """Edit similarity of 0.8 in characters, and three fifths of the words in common."""
    n = max(len(a), len(b))
    if abs(len(a) - len(b)) * 5 > n:
        return False
    x, y = set(a.split(" ")), set(b.split(" "))
    return len(x & y) * 5 >= 3 * max(len(x), len(y)) and distance(a, b) * 5 <= n


def expected(rows, linked=alike):
    """The texts that are left, by comparing all pairs of lines; rows that repeat an id are not for this."""
    places = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate(lines_of(t)):
            if w := normal(line):
                places.setdefault(w, []).append((i, p))
    classes = sorted(places, key=len)
    long_enough = [k for k, c in enumerate(classes) if len(set(c.split(" "))) > 3]
    links = []
    for n, a in enumerate(long_enough):
        for b in long_enough[n + 1 :]:
            if len(classes[a]) < 0.8 * len(classes[b]):
                break
            if linked(classes[a], classes[b]):
                links.append((a, b))
    groups = {}
    for k, c in components(links, range(len(classes))).items():
        groups.setdefault(c, []).extend(places[classes[k]])
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    drop = {x for g in groups.values() for x in sorted(g, key=key)[1:]}
    return {i: (t if not any((i, p) in drop for p in range(len(lines_of(t)))) else "".join(x for p, x in enumerate(lines_of(t)) if (i, p) not in drop)) for i, t in rows}


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def near(line, k):
    w = line.split(" ")
    for _ in range(k):
        w[RNG.randrange(len(w))] = RNG.choice(["xy", "a", "zz", "the"])
    return " ".join(w)


def table():
    base = [sentence(n) for n in (5, 8, 20, 35, 60, 70)]
    rows = []
    for i in range(60):
        lines = [sentence(RNG.randint(1, 30)) for _ in range(RNG.randint(0, 4))]
        for _ in range(RNG.randint(0, 3)):
            b = RNG.choice(base)
            lines.insert(RNG.randint(0, len(lines)), RNG.choice([b, b.upper(), b.replace(" ", ", ") + "!", near(b, 1), near(b, 2)]))
        rows.append((i, "\n".join(lines) + RNG.choice(["", "\n", "\n\n"])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "one two"), (104, (base[4] + " ") * 40), (105, (base[4] + " ") * 40), (106, "the " * 2000), (107, base[2] + "\n" + base[2] + "\n" + base[2])]
    return rows


def test_distance():
    for _ in range(200):
        a, b = ("".join(RNG.choice("abc") for _ in range(RNG.randint(0, 9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert distance(a, b) == row[-1]


def test_against_all_pairs(spark):
    rows = table()
    want = expected(rows)
    out = {r.doc_id: r for r in L.dedup_lines(documents(spark, rows)).collect()}
    assert {i: r.text for i, r in out.items()} == want
    assert sum(r.n_dropped for r in out.values()) > 40
    for i, t in rows:
        assert out[i].n_lines == len(lines_of(t)) and out[i].n_dropped == len(lines_of(t)) - len(lines_of(want[i]))


def test_two_changed_words_never_hide_a_line(spark):
    """Blocks: whichever two words of a line are replaced, deleted or preceded by another one, three of five agree."""
    rows, pairs = [], []
    for k in range(300):
        w = sentence(RNG.randint(5, 60)).split(" ")
        v = list(w)
        for _ in range(2):
            i = RNG.randrange(len(v))
            v[i : i + 1] = RNG.choice([["q"], ["q", v[i]], []])
        rows.append((k, " ".join(w), " ".join(v)))
        pairs.append((w, v))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    got = df.select("k", *[L.sketch(L.features_of(F.col(c))).alias(c) for c in "ab"]).collect()
    for r in got:
        w, v = pairs[r.k]
        if len(set(w)) >= 7 and len(set(v)) >= 5:
            assert len(set(r.a) & set(r.b)) >= L.AGREE


def changed(line, how):
    w = line.split(" ")
    for _ in range(how.count("+") + 1):
        i = RNG.randrange(len(w))
        w[i] = RNG.choice(VOCAB) if how.startswith("word") else w[i] + RNG.choice("abc")
    return " ".join(w)


def test_recall(spark):
    """Of pairs at an edit similarity of 0.8 or more, by characters alone: one or two words replaced, one or two letters added."""
    rows, good, k = [], {}, 0
    for how in ("word", "letter", "word+", "letter+"):
        for low, high, least in ((5, 7, 0.95), (8, 12, 0.99), (13, 25, 0.99), (26, 60, 0.99)):
            mine = good.setdefault((how, low, least), [])
            for _ in range(2000):
                a = sentence(RNG.randint(low, high))
                b = changed(a, how)
                if a != b and distance(a, b) * 5 <= max(len(a), len(b)) and len(mine) < 100:
                    rows += [(2 * k, a), (2 * k + 1, b)]
                    mine.append(2 * k + 1)
                    k += 1
    out = {r.doc_id: r.n_dropped for r in L.dedup_lines(documents(spark, rows)).collect()}
    for (how, low, least), mine in good.items():
        assert len(mine) >= 50 and sum(out[i] for i in mine) >= least * len(mine), (how, low)
    assert not any(n for i, n in out.items() if i % 2 == 0)


def test_one_very_common_line(spark):
    rows = [(i, f"{sentence(6)}\nthe very same line for all of them {'' if i % 2 else '.'}\n") for i in range(400)]
    out = L.dedup_lines(documents(spark, rows)).collect()
    assert sum(r.n_dropped for r in out) == 399
    assert {r.doc_id for r in out if r.n_dropped == 0} == {0}


def test_passages_of_over_fifty_words_go_but_once(spark):
    p = sentence(120)
    rows = [(i, f"{sentence(40)}\n{p}\n{sentence(30)}") for i in range(30)]
    out = {r.doc_id: r.text for r in L.dedup_lines(documents(spark, rows)).collect()}
    assert p in out[0] and not any(p in out[i] for i in range(1, 30))


def test_columns_repeated_ids_null_ids_empty_table(spark):
    rows = [(None, "a b c d e f\nq r s t u v"), (3, "a b c d e f\nx"), (3, "a b c d e f\nx"), (4, "short line")]
    out = L.dedup_lines(documents(spark, rows))
    assert out.columns == [*documents(spark, []).columns, "n_lines", "n_dropped"]
    got = sorted(((r.doc_id or 0), r.text) for r in out.collect())
    assert got == [(0, rows[0][1]), (3, "x"), (3, "x"), (4, "short line")]
    assert L.dedup_lines(documents(spark, [])).count() == 0


def test_rows_with_one_id_and_different_texts(spark):
    rows = [(5, "another unique opening line\nthe end"), (5, "a line that all of them have\nthe middle"), (1, "a line that all of them have"), (5, "the end")]
    got = sorted((r.doc_id, r.text) for r in L.dedup_lines(documents(spark, rows)).collect())
    assert [t for i, t in got if i == 1] == [rows[2][1]]
    assert sorted("".join(t for i, t in got if i == 5).split("\n")) == sorted(["another unique opening line", "the end", "the middle"]) or got.count((5, "")) == 1
    assert any("another unique opening line" in t for i, t in got) and any("the middle" in t for i, t in got)
    assert sum("a line that all of them have" in t for _, t in got) == 1 and sum("the end" in t for _, t in got) == 1


def test_no_python_in_the_plan(spark):
    plan = L.report(documents(spark, table()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
