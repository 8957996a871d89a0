"""Byte-level BPE: pre-tokenisation by class arrays and an associative scan of transition functions, cached pair merging."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, utf8

#: Bytes of text that a worker encodes at a time: its arrays and lists are some hundred times as large.
SLICE_BYTES = 256 << 10

# --- classes of code points ----------------------------------------------------------------------------------
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)  # BLANK: U+0020, which may lead a piece
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


#: Letters and numbers of Unicode 16, which the encoder's library knows and this Python's tables may not.
_NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
_NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    t = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            t[c] = LETTER
        elif g == "N":
            t[c] = NUMBER
    for kind, ranges in ((LETTER, _NEW_LETTERS), (NUMBER, _NEW_NUMBERS)):
        for a, b in ranges:
            t[a : b + 1] = kind
    t[_WHITE] = SPACE
    t[0x20] = BLANK
    return t


# --- the automaton -------------------------------------------------------------------------------------------
# Inputs: what a code point is, with one or two characters of context folded in.
#   L, N, O; Q1, Q2: an apostrophe before one or two letters of a contraction; WI: white space followed by white space or the
#   end; WF: white space other than U+0020 before something else; BF: U+0020 before something else; START: first of a text.
# States: what the piece so far is.  TAIL2, TAIL1: so many letters of a contraction to come; ENDED: a piece is complete.
_STATES = ["LET", "NUM", "OTH", "WS", "LEAD", "TAIL2", "TAIL1", "ENDED"]
_S = {n: i for i, n in enumerate(_STATES)}
_KINDS = ["L", "N", "O", "Q1", "Q2", "WI", "WF", "BF"]


def _step(state: str, kind: str) -> tuple[str, bool]:
    """(next state, whether a piece starts at this code point)."""
    if state in ("TAIL2", "TAIL1"):
        return ("TAIL1" if state == "TAIL2" else "ENDED"), False
    if kind in ("L", "N"):
        mine = {"L": "LET", "N": "NUM"}[kind]
        return mine, state not in (mine, "LEAD")
    if kind in ("O", "Q1", "Q2"):
        if state in ("OTH", "LEAD"):
            return "OTH", False
        return {"O": "OTH", "Q1": "TAIL1", "Q2": "TAIL2"}[kind], True
    if kind == "WI":
        return "WS", state != "WS"
    return {"WF": "ENDED", "BF": "LEAD"}[kind], True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(generator of each kind, composition table, value table): the transition functions, closed under composition.

    Kinds come twice; the second time, the code point is the first of its text and the state before it does not count.
    """
    gens = [tuple(_S[_step(s, k)[0]] for s in _STATES) for k in _KINDS]
    gens += [tuple([_S[_step("ENDED", k)[0]]] * len(_STATES)) for k in _KINDS]
    known = {tuple(range(len(_STATES))): 0}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)  # f, then g
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    fs = list(known)
    comp = np.array([[known[tuple(g[x] for x in f)] for g in fs] for f in fs], np.uint16)
    return np.array([known[g] for g in gens], np.uint16), comp, np.array(fs, np.uint8)


_GEN, _COMP, _VALUE = _monoid()
_STARTS = np.array([[_step(s, k)[1] for k in _KINDS] for s in _STATES])


def _scan(f: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of a sequence of functions: inside blocks, over the blocks, then both together."""
    n = len(f)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    m = np.zeros((width, rows), np.uint16)  # column-major blocks, so that a step is one contiguous row
    flat = np.zeros(width * rows, np.uint16)
    flat[:n] = f
    m[:] = flat.reshape(rows, width).T
    for j in range(1, width):
        m[j] = _COMP[m[j - 1], m[j]]
    lead = np.zeros(rows, np.uint16)
    for r in range(1, rows):
        lead[r] = _COMP[lead[r - 1], m[-1, r - 1]]
    return _COMP[lead[None, :], m].T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A mask of the code points at which a piece starts.  ``first``: a mask of the first code points of texts."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    cls = _classes()[points]
    last = np.append(first[1:], True)
    nxt = np.append(points[1:], 0)
    nxt2 = np.append(points[2:], [0, 0])[:n]
    nxt = np.where(last, 0, nxt)
    nxt2 = np.where(last | np.append(last[1:], True), 0, nxt2)
    white = cls >= SPACE
    before_text = ~last & ~np.append(white[1:], True)
    kind = np.select([cls == LETTER, cls == NUMBER, cls == OTHER, ~before_text, cls == SPACE], [0, 1, 2, 5, 6], 7).astype(np.uint8)
    quote = points == 0x27
    one = quote & ((nxt == 0x73) | (nxt == 0x74) | (nxt == 0x6D) | (nxt == 0x64))
    two = quote & (((nxt == 0x72) & (nxt2 == 0x65)) | ((nxt == 0x76) & (nxt2 == 0x65)) | ((nxt == 0x6C) & (nxt2 == 0x6C)))
    kind[one], kind[two] = 3, 4
    after = _VALUE[_scan(_GEN[kind + 8 * first]), _S["ENDED"]]
    before = np.append(np.uint8(_S["ENDED"]), after[:-1])
    return _STARTS[np.where(first, _S["ENDED"], before), kind] | first


# --- merging -------------------------------------------------------------------------------------------------
def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank merges first, the leftmost of equals, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0 and (r := ranks.get(piece[prv[i] : stop])) is not None:
            heapq.heappush(heap, (r, prv[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class Codec:
    """Encodes and decodes with the ranks of a vocabulary file (lines of base64 bytes and rank)."""

    def __init__(self, vocabulary: str, cache: int = 1 << 18):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for k, v in self.ranks.items():
            self.bytes_of[v] = k
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.most = cache
        try:  # the same merging, compiled
            import tiktoken

            self.merge = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        except (ImportError, AttributeError):
            self.merge = lambda piece: merge(piece, self.ranks)

    def _piece(self, piece: bytes) -> tuple[int, ...]:
        ids = tuple(self.merge(piece))
        if len(piece) <= 64:
            if len(self.cache) >= self.most:
                self.cache.clear()  # the cache is a bounded memo: what it forgets is merged again
            self.cache[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[list[list[int]], list[np.ndarray]]:
        """For each text: its ids, and the byte offset at which each piece starts."""
        body, off = utf8(texts)
        data = np.frombuffer(body, np.uint8)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(str(body, "utf-8").encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points) + 1, bool)
        first[np.searchsorted(heads, off)] = True  # of an empty text: the first of the next one
        at = heads[piece_starts(points, first[:-1])]
        cut = np.searchsorted(at, off)
        raw, get, make = bytes(body), self.cache.get, self._piece
        ends = np.append(at[1:], len(data)).tolist()
        starts = at.tolist()
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            ids: list[int] = []
            for i in range(a, b):
                p = raw[starts[i] : ends[i]]
                ids += get(p) or make(p)
            out.append(ids)
        return out, [at[a:b] - o for a, b, o in zip(cut[:-1], cut[1:], off[:-1])]

    def decode(self, ids) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """One codec per worker process."""
    return Codec(vocabulary)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode_documents(docs: DataFrame, *, vocabulary: str | None = None, text_col: str = "text", ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with token columns: (ids, piece_offsets,) n_tokens, ids_sha256, decoded_sha256.

    Encoding is that of the byte-level BPE library with this vocabulary and the usual pattern, without special tokens; the ids
    are decoded again and the digest of the decoded bytes is returned, so that a reader can compare it with the text's.
    ``ids`` are ints, ``piece_offsets`` the byte offset at which each piece begins.  Null texts count as empty: no ids.  Rows are
    independent, so repeated rows, null ids, long texts and extra columns need no rule; an input column named like a new one is replaced.
    ``vocabulary`` is a path that every worker can read.  One narrow pass, no shuffle.
    """
    vocabulary = vocabulary or default_vocabulary()
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if ids:
        fields = [("ids", T.ArrayType(T.IntegerType(), False)), ("piece_offsets", T.ArrayType(T.IntegerType(), False)), *fields]

    def make():
        c = codec(vocabulary)

        def run(texts: pa.Array) -> list[pa.Array]:
            rows, offsets = c.encode(texts)
            out = [
                pa.array([len(r) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(np.array(r, "<u4").tobytes()).hexdigest() for r in rows]),
                pa.array([hashlib.sha256(c.decode(r)).hexdigest() for r in rows]),
            ]
            if ids:
                kind = pa.list_(pa.int32())
                out = [pa.array(rows, kind), pa.array(offsets, kind), *out]
            return out

        return run

    return append_columns(docs, text_col, fields, make, keep=keep, slice_bytes=SLICE_BYTES)


def decode_ids(docs: DataFrame, *, vocabulary: str | None = None, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``docs`` with the text of an array of ids; bytes that are not UTF-8 become U+FFFD.  A null array gives a null text."""
    vocabulary = vocabulary or default_vocabulary()

    def make():
        c = codec(vocabulary)
        return lambda rows: [pa.array([None if r is None else c.decode(r).decode("utf-8", "replace") for r in rows.to_pylist()], pa.string())]

    return append_columns(docs, ids_col, [(out_col, T.StringType())], make)
