import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomwalk.llm import token_files as T

from .helpers import documents

LIBRARY = Tokenizer.from_file(T.default_vocabulary())
TEXTS = [None, "", " \n", "Hello, world", "don't stop's 123,456 <|endoftext|> x~y", "É È ÉTÉ ñandú. ÿ! ß? İstanbul Ω≈ç√ éá.", "a.b .x x.. word;; \x1c a\x1fb  z", "北京 😀 ok", "~ a ~", "the " * 4000, "x" * 5000, "queaux, queaux. queaux"]


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_encode_like_whole_texts():
    e = T.WordEncoder(T.default_vocabulary(), most=6)  # generations change all the time
    for _ in range(2):
        got = e.encode([(t or "").encode() for t in TEXTS])
        assert [np.frombuffer(g, e.dtype).tolist() for g in got] == [ids(t) for t in TEXTS]


@pytest.mark.parametrize("files", [1, 3])
def test_round_trip(spark, tmp_path, files):
    rows = [(i * 7 % 40, TEXTS[i % len(TEXTS)]) for i in range(40)]
    manifest = T.write_token_files(documents(spark, rows), f"file://{tmp_path}/t", files=files, sequence=64)
    out = {r.doc_id: r for r in T.read_token_files(spark, manifest).collect()}
    at = 0
    for i, t in sorted(rows):
        x = np.array(ids(t), "<u4")
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert len(out) == len(rows)


def test_random_access_is_zero_copy(spark, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(30)]
    (m,) = T.write_token_files(documents(spark, rows), f"file://{tmp_path}/t", files=1, sequence=16).collect()
    f = T.SequenceFile(m.file)
    stream = [x for i, t in rows for x in ids(t)]
    for k in (0, 3, len(stream) // 16):
        tokens, mask = f.sequence(k)
        want = stream[k * 16 : (k + 1) * 16]
        assert tokens.tolist() == want + [0] * (16 - len(want)) and mask.tolist() == [True] * len(want) + [False] * (16 - len(want))
    assert not f.sequence(0)[0].flags.owndata
    assert pa.ipc.open_file(pa.memory_map(m.file.removeprefix("file://"))).schema.field("tokens").type.list_size == 16


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(5, "b"), (5, "a"), (None, "c"), (1, "d")]
    out = T.read_token_files(spark, T.write_token_files(documents(spark, rows), files=2)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == [(False, 0), (True, 1), (True, 5), (True, 5)]
    assert sorted(r.start for r in out)[0] == 0 and [r.start for r in out if r.doc_id is None] == [0]
    assert T.read_token_files(spark, T.write_token_files(documents(spark, []))).count() == 0


def test_special_tokens_are_those_of_the_library():
    texts = ["hello <|startoftext|> x", "a<|endoftext|>b", "<|STARTOFTEXT|> A", "plain words", "", "<|startoftext|", "ends <|endoftext|>"]
    enc = T.WordEncoder(T.default_vocabulary())
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode([t.encode() for t in texts])]
    assert got == [[*LIBRARY.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_places():
    for uri in ("/tmp/x/y", "file:/tmp/x/y", "file:///tmp/x/y"):
        assert T._filesystem(uri)[1] == "/tmp/x/y"
    assert T._filesystem("dbfs:/x/y")[1] == "/dbfs/x/y"
