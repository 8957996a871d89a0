import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken

from loomwalk.llm import bytebpe

from .helpers import documents

FILE = P.path("byte_bpe_multi_50k.tiktoken")
with open(FILE, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    None, "", " ", "  ", "\n", " \n x", "a  b", "I'll don't they've we're he'd 's 't'", "''s 'sa 'rex 've", "x1234y 12 ab12", "été naïve 北京 你好 　 ok", "tab\t\ttab \r\n\r\n end  ",
    "😀👍🏽 family👨‍👩‍👧", "a b c", "́a é", "<|endoftext|> x", "...!!! ,a", "x" * 3000, " " * 500 + "y", "١٢٣ Ⅷ ½", "\x00\x01\x7f",
]


def fuzz(n=400):
    rng = random.Random(3)
    alphabet = "ab'strevlmd 1\n\t ,.é北😀  Ⅷ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pieces_are_those_of_the_pattern():
    texts = [t or "" for t in TEXTS] + fuzz()
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points) + 1, bool)
    first[np.cumsum([0, *map(len, texts)])] = True
    starts = np.flatnonzero(bytebpe.piece_starts(points, first[:-1])).tolist()
    want, at = [], 0
    for t in texts:
        want += [at + m.start() for m in regex.finditer(P.PATTERN, t)]
        at += len(t)
    assert starts == want


def test_merging_without_the_library():
    for t in [x or "" for x in TEXTS] + fuzz(100):
        for m in regex.finditer(P.PATTERN, t):
            piece = m[0].encode()
            assert bytebpe.merge(piece, RANKS) == LIBRARY.encode_ordinary(m[0])


def test_encoding_and_round_trip(spark):
    texts = TEXTS + fuzz(150)
    docs = documents(spark, list(enumerate(texts)))
    out = bytebpe.encode_documents(docs)
    for r in out.collect():
        t = texts[r.doc_id] or ""
        ids = LIBRARY.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.piece_offsets == [len(t[: m.start()].encode()) for m in regex.finditer(P.PATTERN, t)]
    back = bytebpe.decode_ids(out.select("doc_id", "ids")).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}


def test_small_cache_forgets_but_stays_right():
    c = bytebpe.Codec(FILE, cache=3)
    texts = fuzz(50)
    assert c.encode(pa.array(texts))[0] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_scan_is_the_composition_of_all_functions():
    rng = np.random.default_rng(2)
    f = rng.choice(bytebpe._GEN, 1000)
    state, want = 7, []
    for x in f:
        state = bytebpe._VALUE[x][state]
        want.append(state)
    assert bytebpe._VALUE[bytebpe._scan(f), 7].tolist() == want


def test_empty_table(spark):
    assert bytebpe.encode_documents(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5])
def test_columns_with_clashing_names(spark, n):
    docs = documents(spark, [(i, "abc") for i in range(n)]).withColumnRenamed("n", "ids")
    assert bytebpe.encode_documents(docs).count() == n
