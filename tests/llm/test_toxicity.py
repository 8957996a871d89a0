import random
import re
from itertools import combinations

import numpy as np
import pytest

from loomwalk.llm import toxicity

from .helpers import documents, remainder

RNG = random.Random(2)
PLAIN = ["garden", "window", "river", "music", "paper", "silver", "morning", "letter", "number", "people", "coffee", "bridge"]
BAD = ["moronic", "scumbag", "worthless", "pathetic"]


def sentence(n=8):
    return " ".join(RNG.choice(PLAIN) + RNG.choice(["", "s", "ed", "ing"]) for _ in range(n))


def gap(w):
    k = RNG.randrange(1, len(w))
    return RNG.choice([w, w, w[:k] + "*" + w[k:], w[:k] + "-" + w[k:], w[:k] + w[k - 1] + w[k:], " ".join(w), w.upper()])


def corpus(n=900):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        t = ". ".join(sentence() for _ in range(RNG.randint(1, 6)))
        if bad:
            t += f". {sentence(2)} {gap(RNG.choice(BAD))} {sentence(2)}. {sentence()}"
        rows.append((i, t))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def model():
    rows, labels = corpus()
    return toxicity.train([t for _, t in rows], [y for _, y in labels])


def label_table(spark, labels):
    return spark.createDataFrame([(i, 0, y) for i, y in labels], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    out = {r.doc_id: r for r in toxicity.toxicity(documents(spark, rows), label_table(spark, labels)).collect()}
    assert all(out[i].held_out == (remainder(i) == 0) and out[i].predicted == (out[i].score >= 0.5) and 0 <= out[i].score <= 1 for i, _ in labels)
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(300)
    other = [(i, 1 - y if remainder(i) == 0 else y) for i, y in labels]
    a, b = (toxicity.fit(documents(spark, rows), label_table(spark, x)) for x in (labels, other))
    assert a.landmarks == b.landmarks and np.allclose(a.weight, b.weight)


def test_real_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.93


def test_edges(spark):
    rows, labels = corpus(300)
    rows += [(1000, None), (1001, ""), (1002, " \n."), (1003, sentence(30_000)), (1003, "again"), (None, "x")]
    none = label_table(spark, [])
    scores = {r.score for r in toxicity.toxicity(documents(spark, rows), none).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    model = toxicity.fit(documents(spark, rows), label_table(spark, labels))
    docs = documents(spark, rows)
    out = toxicity.score(docs.drop("score"), model)
    assert out.where("score is null").count() == 0 and out.count() == len(rows)
    left = toxicity.drop_toxic(docs, label_table(spark, labels))
    assert left.columns == docs.columns
    assert toxicity.toxicity(documents(spark, []), label_table(spark, labels)).count() == 0
    assert toxicity.toxicity(documents(spark, []), none).count() == 0


def test_classes_that_no_word_tells_apart(spark):
    """Nothing can be learnt, so nothing is rejected, whatever the share of toxic labels."""
    rows = [(i, "the same words in all of them") for i in range(60)]
    labels = label_table(spark, [(i, i % 2) for i in range(60)])
    out = toxicity.toxicity(documents(spark, rows), labels).collect()
    assert {r.predicted for r in out} == {0} and len({r.score for r in out}) == 1
    assert toxicity.drop_toxic(documents(spark, rows), labels).count() == 60


def test_repeated_ids_are_learnt_from_once(spark):
    rows, labels = corpus(300)
    more = rows + [(i, t + " and a longer text") for i, t in rows]
    a, b = (toxicity.fit(documents(spark, x), label_table(spark, labels)) for x in (rows, more))
    assert a.landmarks == b.landmarks and np.allclose(a.weight, b.weight)


@pytest.mark.parametrize("word", ["pathetic", "PATHETIC", "pathxetic", "patheetic", "p.a.t.h.e.t.i.c", "p a t h e t i c", "p4thetic", "pat-hetic"])
def test_spellings(model, word):
    """An insult with letters put in, or spelt otherwise, is as toxic as it is; plain text is not."""
    score = lambda t: float(model.score(*toxicity._bytes([t]))[0])
    assert score(f"{sentence()}. the {word} garden. {sentence()}") > 0.5
    assert score(f"{sentence()}. the silver garden. {sentence()}") < 0.5


def clauses(text):
    """By plain Python: the words of a text, less what is no letter, in clauses; single letters are one word."""
    fold = str.maketrans("0123456789", "oizeasgtbg")
    words, stop, before = [], True, ""
    for raw in re.findall(r"\S+|\s+", text.lower()):
        if raw.isspace():
            before += raw
            continue
        w = "".join(x for x in raw.translate(fold) if "a" <= x <= "z")
        lead = re.match(r"[^a-z0-9]*", raw)[0]
        stop = stop or bool(re.search(r"[.!?\n]", before + lead))
        if w:
            if len(w) == 1 and words and words[-1][2]:
                words[-1] = (words[-1][0] + w, words[-1][1], True)
            else:
                words.append((w, stop, len(w) == 1))
            stop, before = False, ""
        before = re.search(r"[^a-z0-9]*$", raw)[0]
    out, n = [], 0
    for w, first, _ in words:
        if first or n == toxicity.CLAUSE:
            out.append("")
            n = 0
        out[-1] += " " + w
        n += 1
    return out


def test_clauses():
    texts = ["You are s t u p i d, really. No! i.d.i.o.t", "", "a b c", "one two three four five. six", "?", "x1 yy", "p4thetic w0rd\nnext"]
    for t in texts:
        assert toxicity.clauses_of(*toxicity._bytes([t])).strings() == clauses(t), t
    all_at_once = toxicity.clauses_of(*toxicity._bytes(texts))
    assert all_at_once.strings() == [x for t in texts for x in clauses(t)]
    assert all_at_once.text.tolist() == [i for i, t in enumerate(texts) for _ in clauses(t)]


def plain_features(clause, rarity):
    """All subsequences, by all choices of positions."""
    letters = [toxicity._SPACE if x == " " else ord(x) - 97 for x in clause]
    out = {}
    for at in combinations(range(len(letters)), toxicity.ORDER):
        if at[-1] - at[0] < toxicity.SPAN:
            code = 0
            for i in at:
                code = code * 32 + letters[i]
            out[code] = out.get(code, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
    out = {c: v * float(rarity[c]) for c, v in out.items()}
    size = sum(v * v for v in out.values()) ** 0.5
    return {c: v / size for c, v in out.items()} if size else {}


TEXTS = ["the pathetic garden", "pathxetic and aaaaaaa", "window. scum", "silver silver", "an idiot i d i o t"]


def test_kernel_map_and_score_by_brute_force(model):
    c = toxicity.clauses_of(*toxicity._bytes(TEXTS))
    plain = [plain_features(x, model.rarity) for x in c.strings()]
    dot = lambda a, b: sum(v * b.get(k, 0.0) for k, v in a.items())
    marks = toxicity.Landmarks.of(c, model.rarity)
    k = np.array([[dot(a, b) for b in plain] for a in plain])
    assert marks.kernel(c, model.rarity) == pytest.approx(k, abs=1e-5)
    # The map: inner products of the mapped clauses are those of the kernel, in the space of the landmarks.
    some = toxicity.Landmarks.of(c.pick(np.arange(3)), model.rarity)
    x = some.kernel(c, model.rarity) @ some.root()
    assert x @ x.T == pytest.approx(k[:, :3] @ np.linalg.inv(k[:3, :3]) @ k[:3], abs=1e-3)
    # The machine: a weight per subsequence is the sum over landmarks of weight times kernel value.
    w = np.array([0.5, -1.0, 2.0])
    folded = some.weights(w)
    assert [dot(a, {i: folded[i] for i in a}) for a in plain] == pytest.approx(k[:, :3] @ w, abs=1e-4)
    # The score: the worst clause of a text, or an empty one.
    values = np.array([dot(a, {i: model.weight[i] for i in a}) for a in plain])
    want = [max([0.0, *values[c.text == i]]) + model.bias for i in range(len(TEXTS))]
    assert model.decide(*toxicity._bytes(TEXTS)) == pytest.approx(want, abs=1e-4)
    assert all(b >= v - 1e-4 for b, v in zip(model.bounds(c), values) if v > 0)


def test_svm_is_at_its_minimum():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 4)), np.where(rng.random(60) < 0.3, 1.0, -1.0)
    w, b = toxicity._svm(x, y, cost=5.0 / (y > 0).sum())

    def loss(w, b):
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        return 0.5 * w @ w + 5e-7 * b * b + 5 * (share * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()

    best = loss(w, b)
    assert all(loss(w + 0.01 * rng.normal(size=4), b + 0.01 * rng.normal()) > best for _ in range(50))
