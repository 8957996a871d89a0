"""Toxicity: a support vector machine over a gapped subsequence string kernel with Nystroem landmarks.

The kernel.  A sentence is read in clauses of a few words; of a clause the letters count, digits that stand for letters among them, and one space before each word.  Its features
are all subsequences of ORDER letters that span at most SPAN letters, each occurrence weighing DECAY to the power of its span, times the subsequence's
rarity among clean clauses; the kernel of two clauses is the cosine of their features.  Marks don't count, letters that stand alone are one word, and
gaps are part of the features, so an insult with letters put between its own, or spelt with marks or spaces, stays near the plain one.

The machine.  Landmarks are clauses sampled from the training texts.  A clause is mapped to its kernel values with them times the inverse root of the
landmarks' own kernel matrix, and a linear machine is trained on that.  As the features are known, map and machine together are one weight per
subsequence, so that scoring needs no kernel value.  A text is as toxic as its worst clause.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_batches, cut, give_back, utf8
from .words import LOWER, mix

#: The bound of the training sample: labelled documents of each class, in the order of a hash, and bytes of text in all.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1000, 1500, 32 << 20
#: Clauses of clean documents that rarity is counted in; that are negative examples, half of them those that the machine is most wrong about; and most clauses of
#: one toxic document that are positive ones.
COUNTED, NEGATIVES, WITNESSES = 20_000, 8_000, 8
#: Subsequences of so many letters that span at most SPAN; one that spans s weighs DECAY ** s.
ORDER, SPAN, DECAY = 3, 5, 0.75
#: Rarity is the logarithm of the inverse share of clauses with a subsequence, over its greatest value, to this power.
RARITY = 2
#: Words in a clause.
CLAUSE = 2
#: Weight of the training errors, for each positive example; errors of both classes weigh alike in all.
COST = 0.5
#: Landmarks from toxic and from clean documents.
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 384, 128
FOLDS = 5
#: Bytes of text that a worker scores at a time: the arrays are some hundred times as large.
SLICE_BYTES = 256 << 10

_CODES = 32**ORDER
_CLASS = np.full(256, 255, np.uint8)
_CLASS[0x61:0x7B] = np.arange(26)
for _d, _c in zip(b"0123456789", b"oizeasgtbg"):  # digits that stand for letters
    _CLASS[_d] = _c - 0x61
_CLASS[0x80:0xC0] = 26 + np.arange(64) % 6  # the last byte of a non-ASCII character tells it well enough
_SPACE = 31  # stands before each word
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_OFFSETS = [(0, *mid, q) for q in range(ORDER - 1, SPAN) for mid in combinations(range(1, q), ORDER - 2)]


@dataclass
class Clauses:
    """The letters of some texts, each with its clause, and the text of each clause; clauses are numbered without gaps."""

    letter: np.ndarray
    clause: np.ndarray  # of each letter, rising
    text: np.ndarray  # of each clause

    def __len__(self) -> int:
        return len(self.text)

    def pick(self, which: np.ndarray) -> Clauses:
        """Some of the clauses, in rising order."""
        mine = np.zeros(len(self), bool)
        mine[which] = True
        place = np.cumsum(mine) - 1
        keep = mine[self.clause]
        return Clauses(self.letter[keep], place[self.clause[keep]], self.text[mine])

    def strings(self) -> list[str]:
        ends = np.searchsorted(self.clause, np.arange(len(self) + 1))
        names = np.array([*"abcdefghijklmnopqrstuvwxyz123456"[:_SPACE], " "])[self.letter]
        return ["".join(names[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def clauses_of(data: np.ndarray, off: np.ndarray) -> Clauses:
    """Texts as bytes and offsets, cut into clauses.

    A sentence ends after one of ``.!?`` or a line end, where white space or a word with other letters follows; a clause is CLAUSE words of it at most.  A word is a
    run without white space; a run of words of one letter is one word."""
    low = LOWER[data]
    white = _WHITE[low]
    head = np.zeros(len(low) + 1, bool)
    head[off[:-1]] = True
    head = head[:-1]
    begins = ~white & (np.append(True, white[:-1])[: len(low)] | head)
    word = np.cumsum(begins, dtype=np.int32)
    at = np.flatnonzero(_CLASS[low] < 255)
    if not len(at):
        return Clauses(np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int64))
    letter, word = _CLASS[low[at]], word[at]
    # A stop inside a word, as in "i.d.i.o.t", ends nothing: what counts is the number of stops before the word's first letter.
    stops = np.cumsum(_STOP[low], dtype=np.int32)[at]
    first = np.append(True, word[1:] != word[:-1])
    lead = np.flatnonzero(first)
    size = np.diff(np.append(lead, len(at)))
    w_text, w_stops, single = np.searchsorted(off, at[lead], "right") - 1, stops[lead], size == 1
    last_stops = stops[np.append(lead[1:], len(at)) - 1]
    apart = np.append(True, (w_text[1:] != w_text[:-1]) | (w_stops[1:] != last_stops[:-1]))
    glued = single & np.append(False, single[:-1]) & ~np.append(True, w_text[1:] != w_text[:-1])
    fresh = ~glued  # words, single letters joined
    sentence = np.cumsum(apart & fresh)[fresh]
    number = np.arange(len(sentence))
    begin = np.append(True, sentence[1:] != sentence[:-1])
    place = number - np.maximum.accumulate(np.where(begin, number, 0))
    clause = np.cumsum(begin | (place % CLAUSE == 0)) - 1
    of_word = clause.astype(np.int32)[np.cumsum(fresh) - 1]
    opens = np.append(True, clause[1:] != clause[:-1])
    begins = lead[fresh]
    return Clauses(np.insert(letter, begins, _SPACE), np.insert(np.repeat(of_word, size), begins, clause), w_text[fresh][opens])


def _subsequences(c: Clauses) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(whether it lies in one clause, code, span) of the subsequences that begin at each letter, for each choice of gaps."""
    n = len(c.letter)
    for offsets in _OFFSETS:
        if n > (q := offsets[-1]):
            code = c.letter[: n - q].astype(np.int32)
            for o in offsets[1:]:
                code = code * 32 + c.letter[o : n - q + o]
            yield c.clause[q:] == c.clause[: n - q], code, q + 1


def _parts(c: Clauses, step: int) -> Iterator[tuple[Clauses, int]]:
    """Runs of whole clauses of about ``step`` letters, each with the number of its first clause."""
    lo = 0
    while lo < len(c.letter):
        hi = min(len(c.letter), lo + step)
        hi = int(np.searchsorted(c.clause, c.clause[hi - 1], "right"))
        base, end = int(c.clause[lo]), int(c.clause[hi - 1]) + 1
        yield Clauses(c.letter[lo:hi], c.clause[lo:hi] - base, c.text[base:end]), base
        lo = hi


def counts(c: Clauses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clause, code, weight) of the subsequences of all clauses, by clause and code."""
    keys = [np.zeros(0, np.int64)]
    for ok, code, span in _subsequences(c):
        at = np.flatnonzero(ok)
        keys.append((c.clause[at].astype(np.int64) * _CODES + code[at]) * 8 + (span - ORDER))
    key = np.sort(np.concatenate(keys))
    weight, key = (DECAY ** np.arange(ORDER, ORDER + 8))[key & 7], key >> 3
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    key = key[starts]
    return key // _CODES, key % _CODES, np.add.reduceat(weight, starts) if len(starts) else weight


def features(c: Clauses, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`counts` times rarity, scaled to length one in each clause."""
    clause, code, value = counts(c)
    value = value * rarity[code]
    return clause, code, value / np.sqrt(np.maximum(np.bincount(clause, value * value, len(c)), 1e-30))[clause]


def rarity_of(clean: Clauses) -> np.ndarray:
    """The rarity of every subsequence: 1 where no clause has it."""
    df = np.zeros(_CODES)
    for part, _ in _parts(clean, 1 << 16):
        df += np.bincount(counts(part)[1], minlength=_CODES)
    n = len(clean) + 1
    return (np.maximum(0, np.log(n / (df + 1)) / np.log(n + 1e-9)) ** RARITY).astype(np.float32)


@dataclass
class Landmarks:
    names: list[str]
    row: np.ndarray  # of each code its row in the table; row 0 is empty
    table: np.ndarray  # (codes in use, landmarks): the landmarks' features

    @staticmethod
    def of(c: Clauses, rarity: np.ndarray) -> Landmarks:
        clause, code, value = features(c, rarity)
        used, at = np.unique(code, return_inverse=True)
        table = np.zeros((len(used) + 1, len(c)), np.float32)
        table[at + 1, clause] = value
        row = np.zeros(_CODES, np.int32)
        row[used] = np.arange(1, len(used) + 1)
        return Landmarks(c.strings(), row, table)

    def kernel(self, c: Clauses, rarity: np.ndarray) -> np.ndarray:
        """Kernel values of all clauses with the landmarks."""
        out = np.zeros((len(c), self.table.shape[1]), np.float32)
        for part, base in _parts(c, 1 << 9):
            clause, code, value = features(part, rarity)
            row = self.row[code]
            some = np.flatnonzero(row)
            if len(some):
                clause = clause[some]
                starts = np.flatnonzero(np.append(True, clause[1:] != clause[:-1]))
                out[base + clause[starts]] = np.add.reduceat(self.table[row[some]] * value[some, None].astype(np.float32), starts, axis=0)
        return out

    def root(self) -> np.ndarray:
        """The Nystroem map: the inverse root of the landmarks' kernel matrix, which takes kernel values to coordinates in the space that they span."""
        value, vector = np.linalg.eigh((self.table.T @ self.table).astype(np.float64))
        return ((vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T).astype(np.float32)

    def weights(self, of_landmarks: np.ndarray) -> np.ndarray:
        """A weight per subsequence: that of each landmark times its features."""
        return (self.table @ of_landmarks.astype(np.float32))[self.row]


@dataclass
class Model:
    landmarks: list[str]
    weight: np.ndarray  # of each subsequence
    rarity: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def bounds(self, c: Clauses) -> np.ndarray:
        """The value of each clause without the bias, as if no subsequence came twice in it: if positive, it is at least the true one."""
        over, square = np.zeros(len(c.letter), np.float32), np.zeros(len(c.letter), np.float32)
        for ok, code, span in _subsequences(c):
            n = len(code)
            rare = self.rarity[code] * (ok * np.float32(DECAY**span))
            over[:n] += self.weight[code] * rare
            square[:n] += rare * rare
        total, square = np.bincount(c.clause, over, len(c)), np.bincount(c.clause, square, len(c))
        return total / np.sqrt(np.maximum(square, 1e-30)) * (1 + 1e-5)

    def values(self, c: Clauses) -> np.ndarray:
        """The value of each clause without the bias."""
        clause, code, value = features(c, self.rarity)
        return np.bincount(clause, self.weight[code] * value, len(c))

    def decide(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The largest decision value over the clauses of each text; that of an empty clause at least.

        Bounds need no sorting; only clauses whose bound is above the best value of their text are worked out."""
        best = np.zeros(len(off) - 1)
        c = clauses_of(data, off)
        if len(c):
            bound = _bounds(self, c)
            order = np.lexsort((-bound, c.text))
            top = order[np.append(True, c.text[order][1:] != c.text[order][:-1])]
            rest = bound > 0
            for which in (np.sort(top[bound[top] > 0]), None):
                if which is None:
                    which = np.flatnonzero(rest & (bound > best[c.text]))
                rest[which] = False
                some = c.pick(which)
                for part, _ in _parts(some, 1 << 16):
                    np.maximum.at(best, part.text, self.values(part))
        return best + self.bias

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decide(data, off) + self.shift, -30, 30)))


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """The texts, so many at a time that they have SLICE_BYTES characters, or one text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > SLICE_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def clauses_in(texts: list[str]) -> Clauses:
    """:func:`clauses_of` all texts; beside the clauses, the memory is that of one run."""
    parts, n_clauses, n_texts = [clauses_of(*_bytes([]))], 0, 0
    for run in _runs(texts):
        c = clauses_of(*_bytes(run))
        parts.append(Clauses(c.letter, c.clause + np.int32(n_clauses), c.text + n_texts))
        n_clauses, n_texts = n_clauses + len(c), n_texts + len(run)
    return Clauses(*(np.concatenate([getattr(c, f) for c in parts]) for f in ("letter", "clause", "text")))


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _word_sets(texts: list[str]) -> Iterator[set[str]]:
    return ({m[0][i : i + 24] for m in re.finditer(r"[^\W_]+", t.lower()) for i in range(0, len(m[0]), 24)} for t in texts)


def _unlike(sets: Iterator[set[str]], k: int = 16) -> Iterator[set[str]]:
    """Sets less those that share half of their k least word hashes with an earlier one: copies are one witness."""
    seen: dict[int, list[int]] = defaultdict(list)
    n = 0
    for s in sets:
        sketch = sorted(zlib.crc32(w.encode()) for w in s)[:k]
        met = Counter(i for h in sketch for i in seen[h])
        if not met or max(met.values()) * 2 < len(sketch):
            for h in sketch:
                seen[h].append(n)
            n += 1
            yield s


def _substrings(words: list[str], sizes: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word, start in the word, size) of every substring of the words."""
    size = np.array([len(w) for w in words], int)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    out = []
    h = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(sizes.stop - 1):
            h = h[: len(points) - k] if k else h
            if not len(h):
                break
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k:]
            if k + 1 >= sizes.start:
                at = np.flatnonzero(word[k:] == word[: len(word) - k])
                out.append((mix(h[at] + np.uint64(k)), word[at], place[at], np.full(len(at), k + 1)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.uint64, int, int, int))


def suspects(toxic: list[str], clean: list[str], most: int = 64) -> list[str]:
    """Where the first guess at the toxic clauses comes from: substrings of words that many toxic and hardly any clean documents hold.  They are
    chosen one by one for the words that none before them is in; of those nearly as good as the best, the longest."""
    pos, neg = Counter(), Counter()
    n = 0
    for s in _unlike(_word_sets(toxic)):
        pos.update(s)
        n += 1
    for s in _word_sets(clean):
        neg.update(s)
    rate = n / max(1, len(clean))
    words = sorted(w for w, k in pos.items() if len(w) >= 4 and neg[w] * rate <= 0.05 * k)
    df = np.array([pos[w] for w in words], float)
    least = max(4.0, 0.015 * n)
    code, word, start, size = _substrings(words, range(4, 11))
    if not len(code):
        return []
    names, ident = np.unique(code, return_inverse=True)
    total = np.bincount(ident, df[word])
    against = np.zeros(len(names))
    plain = [w for w in neg if len(w) >= 4]
    weight = np.array([neg[w] for w in plain], float)
    for i in range(0, len(plain), 4000):
        c, w, _, _ = _substrings(plain[i : i + 4000], range(4, 11))
        k = np.minimum(np.searchsorted(names, c), len(names) - 1)
        hit = names[k] == c
        against += np.bincount(k[hit], weight[i + w[hit]], minlength=len(names))
    good = (total >= least) & (against * rate <= 0.02 * total)
    mine = good[ident]
    ident, word, start, size = ident[mine], word[mine], start[mine], size[mine]
    length = np.zeros(len(names), int)
    length[ident] = size
    sample = np.zeros(len(names), int)
    sample[ident] = np.arange(len(ident))
    free, chosen = np.ones(len(words)), []
    pair = np.unique(ident * len(words) + word)
    ident2, word2 = pair // len(words), pair % len(words)
    while len(chosen) < most and len(ident2):
        gain = np.bincount(ident2, (df * free)[word2], minlength=len(names))
        top = gain.max()
        if top < least:
            break
        near = np.flatnonzero(gain >= 0.9 * top)
        best = max(near, key=lambda i: (length[i], gain[i], i))
        at = sample[best]
        chosen.append(words[word[at]][start[at] : start[at] + size[at]])
        free[word2[ident2 == best]] = 0
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = 40) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton's method; classes weigh alike."""
    cost *= max(1, (y > 0).sum())
    s = cost * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    plain = np.append(np.ones(x.shape[1]), 1e-6)

    def some(i: int) -> np.ndarray:
        """Rows of ``x`` and a one, in double precision: never all rows at once."""
        part = x[i : i + 1024]
        return np.hstack([part, np.ones((len(part), 1), x.dtype)]).astype(np.float64)

    def slack_of(w: np.ndarray) -> np.ndarray:
        return np.maximum(0, 1 - y * np.concatenate([some(i) @ w for i in range(0, len(x), 1024)]))

    def loss(w: np.ndarray, slack: np.ndarray) -> float:
        return 0.5 * (plain * w * w).sum() + (s * slack**2).sum()

    w = np.zeros(len(plain))
    slack = slack_of(w)
    now = loss(w, slack)
    for _ in range(rounds):
        grad, curve = plain * w, np.diag(plain)
        for i in range(0, len(x), 1024):
            a, k = some(i), slice(i, i + 1024)
            grad -= 2 * (a.T @ (s[k] * y[k] * slack[k]))
            a, weigh = a[slack[k] > 0], s[k][slack[k] > 0]
            curve += 2 * (a.T * weigh) @ a
        step = np.linalg.solve(curve, grad)
        size, left = 1.0, slack_of(w - step)
        then = loss(w - step, left)
        while then > now and size > 1e-3:
            size /= 2
            left = slack_of(w - size * step)
            then = loss(w - size * step, left)
        if then >= now * (1 - 1e-9):
            break
        w, now, slack = w - size * step, then, left
    return w[:-1], float(w[-1])


def _sample(n: int, most: int, rng: np.random.Generator) -> np.ndarray:
    return np.sort(rng.permutation(n)[:most])


def _ranked(value: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """The rank of each clause among those of its text, by falling value, is below ``most``."""
    order = np.lexsort((-value, text))
    begin = np.append(True, text[order][1:] != text[order][:-1])
    number = np.arange(len(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = number - np.maximum.accumulate(np.where(begin, number, 0))
    return rank < most


def _bounds(model: Model, c: Clauses) -> np.ndarray:
    return np.concatenate([model.bounds(part) for part, _ in _parts(c, 1 << 16)])


def train(texts: list[str], labels: list[int], rates: tuple[float, float] = (1.0, 1.0), seed: int = 7) -> Model:
    """Fits landmarks, machine and calibration.  ``rates``: the share of all clean and of all toxic documents that the sample holds.

    A toxic document has a toxic clause, not only such.  Its first witnesses are the clauses with a suspect word; after each fit, its witnesses are
    those of its clauses that the machine finds toxic.  Clauses of clean documents are negative.  With one class only, or no suspects, nothing is learnt: every
    text then scores the share of toxic documents, and below one half.
    """
    toxic = [t for t, y in zip(texts, labels) if y]
    clean = [t for t, y in zip(texts, labels) if not y]
    share = (len(toxic) / rates[1] + 0.5) / (len(toxic) / rates[1] + len(clean) / rates[0] + 1)
    none = np.zeros(_CODES, np.float32)
    blank = Model([], none, none, 0.0, 0.0, float(min(np.log(share / (1 - share)), -0.1)) if texts else -30.0)
    words = [w.strip() for w in clauses_of(*_bytes(suspects(toxic, clean))).strings() if len(w) > ORDER] if toxic and clean else []
    bad, good = clauses_in(toxic), clauses_in(clean)
    suspect = re.compile("|".join(map(re.escape, words)) or "(?!)")
    mine = np.flatnonzero([suspect.search(x) is not None for part, _ in _parts(bad, 1 << 16) for x in part.strings()])
    if not len(mine) or not len(good):
        return blank
    rng = np.random.default_rng(seed)
    rarity = rarity_of(good.pick(_sample(len(good), COUNTED, rng)))
    mine = mine[_ranked(rng.random(len(mine)), bad.text[mine], WITNESSES)]
    chosen = bad.pick(mine[_sample(len(mine), TOXIC_LANDMARKS, rng)]), good.pick(_sample(len(good), CLEAN_LANDMARKS, rng))
    marks = Landmarks.of(Clauses(*(np.concatenate([getattr(x, f) + (k * n if f != "letter" else 0) for k, x in enumerate(chosen)]) for f, n in (("letter", 0), ("clause", len(chosen[0])), ("text", 0)))), rarity)
    root = marks.root()
    model = Model(marks.names, none, rarity, 0.0)
    easy = marks.kernel(good.pick(_sample(len(good), NEGATIVES // 2, rng)), rarity) @ root
    hard = easy[:0]
    for k in range(3):
        positive = marks.kernel(bad.pick(mine), rarity) @ root
        x, n = np.vstack([positive, easy, hard]), len(positive)
        del positive
        w, model.bias = _svm(x, np.append(np.ones(n), -np.ones(len(x) - n)).astype(np.float32))
        del x
        model.weight = marks.weights(root @ w)
        if k < 2:
            value = _bounds(model, bad) + model.bias
            found = np.flatnonzero((value > 0) & _ranked(value, bad.text, WITNESSES))
            mine = found if len(found) else mine
            hard = marks.kernel(good.pick(np.argsort(-_bounds(model, good), kind="stable")[: NEGATIVES // 2]), rarity) @ root
    # Calibration: a logistic curve through the decision values of the documents, by Newton's method; classes weigh as among all labels.
    d = np.concatenate([model.decide(*_bytes(run)) for part in (toxic, clean) for run in _runs(part)])
    y = np.append(np.full(len(toxic), 1 - 1 / (len(toxic) + 2)), np.full(len(clean), 1 / (len(clean) + 2)))
    weigh = np.append(np.full(len(toxic), 1 / rates[1]), np.full(len(clean), 1 / rates[0]))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        g = np.array([(weigh * (p - y) * d).sum() + 1e-3 * a, (weigh * (p - y)).sum()])
        r = weigh * p * (1 - p) + 1e-9
        h = np.array([[(r * d * d).sum() + 1e-3, (r * d).sum()], [(r * d).sum(), r.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    model.slope, model.shift = float(a), float(b)
    return model


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves no remainder: such rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """The training sample (id, y, t), and the number of labelled documents of each class that it stands for; held-out ones aside.

    The sample is bounded: in the order of a hash of the id, up to SAMPLE_TOXIC toxic and SAMPLE_CLEAN clean documents and SAMPLE_BYTES of text; a text that
    does not fit is skipped.  Of rows that repeat an id the shortest text counts.  Null labels and texts do not count; of an id with several labels, toxic wins."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out("id"))
    order = F.xxhash64("id")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    part = lambda y, n: known.where(F.col("y") == y).orderBy(order, "id").limit(n)
    ids = cut(part(1, SAMPLE_TOXIC).unionByName(part(0, SAMPLE_CLEAN)), "toxicity-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(ids), "id")
    text = F.min(F.struct(F.octet_length("t").alias("n"), "t"))
    rows = cut(rows.where(F.octet_length("t") <= SAMPLE_BYTES).groupBy("id", "y").agg(text.alias("r")).select("id", "y", "r.n", "r.t"), "toxicity-sample")
    total, fits = 0, []
    for r in rows.select("id", "n", order.alias("h")).orderBy("h", "id").collect():
        if total + r.n <= SAMPLE_BYTES:
            total += r.n
            fits.append((r.id,))
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "id long")), "id").select("id", "y", "t")
    return rows, {r.y: r.c for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    """A model of the labelled documents that are not held out: one task trains on :func:`training_rows`; the driver gets only the model."""
    bounded_batches(docs.sparkSession)
    rows, count = training_rows(docs, labels, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, t.decode(), y) for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns)))
        y = [x[2] for x in got]
        rates = tuple(y.count(k) / max(1, count.get(k, 0)) or 1.0 for k in (0, 1))
        model = pickle.dumps(train([x[1] for x in got], y, rates))
        del got
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = rows.select("id", "y", F.col("t").cast("binary")).coalesce(1).mapInArrow(run, "model binary").first()
    return train([], []) if made is None else pickle.loads(made.model)  # no rows may mean no task


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a score from 0 to 1: higher, the likelier the text is toxic.

    The whole text is read; its score is that of its most toxic clause.  Null and empty texts get the score of an empty clause.  Rows
    are independent; other columns pass through, save one named like the score.  One narrow pass, no shuffle; the broadcast model has one weight for each
    subsequence, whatever the sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts: pa.Array) -> list[pa.Array]:
            body, off = utf8(texts)
            return [pa.array(m.score(np.frombuffer(body, np.uint8), off), pa.float64())]

        return run

    return append_columns(docs, text_col, [(out_col, T.DoubleType())], make, keep=keep, slice_bytes=SLICE_BYTES)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: (doc_id, held_out, score, predicted)."""
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The documents whose score is below ``most``, with the columns of ``docs`` whatever their names."""
    model = fit(docs, labels, text_col=text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    return score(packed, model, text_col="__text", out_col="__score", keep=["__row"]).where(F.col("__score") < most).select("__row.*")
