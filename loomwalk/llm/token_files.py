"""Token ids in Arrow files of equal-length sequences with masks, for zero-copy random access."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, cut, fresh_path, utf8

SEQUENCE = 1024
#: Sequences in one record batch.
BATCH = 256
END_ID = 1
#: Documents of a file, about: its index is held while it is written.
FILE_DOCUMENTS = 1_000_000


#: Words of lower-case Latin letters, and perhaps one mark after them: the splitter makes one piece of the letters and one of the mark.
_MARKS = frozenset(".,;:!?")
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+[.,;:!?]?")


class WordEncoder:
    """The tokenizers library behind a memo of words, bounded by two generations of ``most`` words.

    The vocabulary's normaliser lower-cases, and neither it nor the splitter joins characters across ASCII white space, so a text's ids are
    those of its lower-cased words.  Plain words that the memo lacks skip the splitter; other words are encoded
    together, with a separator word of one token between them.  Texts with a special token, in any case of letters, go to the library whole.
    """

    def __init__(self, vocabulary: str, most: int = 300_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.sign = re.match(rb"[^a-z]*", commonprefix(self.special))[0]  # what they begin with, in any case of letters
        self.tok = Tokenizer.from_file(vocabulary)
        self.tok.encode_special_tokens = True  # what it gets has none, or had them in other letters
        self.memo: dict[bytes, bytes] = {}
        self.last: dict[bytes, bytes] = {}
        self.most = most
        self.dtype = np.dtype(np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        self.mark = "~"
        (self.mark_id,) = self._ids(self.mark)
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.plain = Tokenizer.from_file(vocabulary)  # the same model; words need no normaliser and no splitter but for white space
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        if hasattr(self.plain.model, "_resize_cache"):
            self.plain.model._resize_cache(0)  # it meets a word once; the memo is the cache
        self.last_piece = np.zeros(self.tok.get_vocab_size(), bool)
        self.last_piece[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        probe = ["grüße", "ça", "naïve", "ÿ", "a", "the", "queauxß"]
        self.fast = self._letters(probe) == [self._raw(w) for w in probe]

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _raw(self, text: str) -> bytes:
        return np.array(self._ids(text), self.dtype).tobytes()

    def _letters(self, words: list[str]) -> list[bytes] | None:
        """The ids of words of lower-case Latin letters; none if the model doesn't end words with a piece of their own."""
        parts = [" ".join(words[i : i + 1024]) for i in range(0, len(words), 1024)]
        out, n = [], self.dtype.itemsize
        for e in self.plain.encode_batch_fast(parts, add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            raw, a = ids.tobytes(), 0
            for b in ((np.flatnonzero(self.last_piece[ids]) + 1) * n).tolist():
                out.append(raw[a:b])
                a = b
        return out if len(out) == len(words) else None

    def _learn(self, words: list[bytes]) -> None:
        memo, rest, tailed, letters = self.memo, [], [], {}
        if self.fast:
            strings = b" ".join(words).decode().split(" ")
            for w, s, plain in zip(words, strings, map(_PLAIN.fullmatch, strings)):
                if plain is None:
                    rest.append(w)
                elif s[-1] in _MARKS:
                    tailed.append((w, s[:-1], s[-1]))
                else:
                    letters[s] = w
        fresh = {s: None for _, s, _ in tailed if s not in letters and s.encode() not in memo}
        new = [*letters, *fresh]
        ids = dict(zip(new, self._letters(new) or map(self._raw, new)))
        memo.update(zip(letters.values(), map(ids.__getitem__, letters)))
        marks = {x: self._marks(x) for _, _, x in tailed}
        for w, s, tail in tailed:
            memo[w] = (ids[s] if s in ids else memo[s.encode()]) + marks[tail]
        if not self.fast:
            rest = words
        mark = self.mark.encode()
        for i in range(0, len(rest), 2048):
            part = [w for w in rest[i : i + 2048] if mark not in w]
            ids = np.array(self._ids(f" {self.mark} ".join([*(w.decode() for w in part), ""])), self.dtype)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) == len(part):
                raw, n = ids.tobytes(), self.dtype.itemsize
                a = 0
                for w, e in zip(part, ends.tolist()):
                    memo[w] = raw[a * n : e * n]
                    a = e + 1
        for w in rest:
            if w not in memo:
                memo[w] = self._raw(w.decode())

    @lru_cache(maxsize=64)
    def _marks(self, mark: str) -> bytes:
        return self._raw(mark)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, and the end id, as bytes of ``dtype``."""
        special = [i for i, t in enumerate(texts) if self.sign in t and any(x in t.lower() for x in self.special)]
        if special:
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in set(special)]))
            mine = {i: np.array(self.whole.encode(texts[i].decode(), add_special_tokens=False).ids, self.dtype).tobytes() + self.end for i in special}
            return [mine[i] if i in mine else next(rest) for i in range(len(texts))]
        words = [t.lower().split() for t in texts]
        every = set().union(*words)
        new = list(every.difference(self.memo))
        if len(self.memo) + len(new) > self.most:  # a new generation; what is still in use comes over from the last one
            self.last, self.memo = self.memo, {}
            new = list(every)
        if self.last:
            last, memo = self.last.get, self.memo
            for w in new:
                if (ids := last(w)) is not None:
                    memo[w] = ids
            new = [w for w in new if w not in memo]
        self._learn(new)
        get = self.memo.__getitem__
        return [b"".join(map(get, ws)) + self.end for ws in words]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> WordEncoder:
    """One encoder per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(vocabulary)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Schemes of Hadoop's clients and the ones that Arrow knows for the same stores.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "dbfs": "file"}


def _filesystem(uri: str):
    """(file system, path) of a place in the shared folder; ``dbfs:/`` is the mount that workers see as /dbfs."""
    from pyarrow import fs

    scheme, mark, rest = uri.partition(":")
    if not mark or "/" in scheme:
        scheme, rest = "file", f"//{uri}"
    if scheme == "dbfs":
        rest = "/dbfs/" + rest.lstrip("/")
    if scheme in ("file", "dbfs"):
        rest = "//" + rest if not rest.startswith("//") else rest
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


class SequenceWriter:
    """One file of sequences and its index of documents; both appear under their final names only when complete."""

    def __init__(self, uri: str, dtype, length: int):
        self.fs, self.path = _filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.dtype, self.length = np.dtype(dtype), length
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.temp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.index: list[tuple[int | None, int, int]] = []
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.total, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BATCH * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.zeros(0, self.dtype)
        step = BATCH * self.length
        whole = len(flat) - len(flat) % step
        for i in range(0, whole, step):
            self._batch(flat[i : i + step], step)
        rest = flat[whole:]
        if last and len(rest):
            self._batch(rest, -(-len(rest) // self.length) * self.length)
            rest = rest[:0]
        self.pending, self.held = ([rest] if len(rest) else []), len(rest)

    def _batch(self, ids: np.ndarray, size: int) -> None:
        tokens, mask = np.zeros(size, self.dtype), np.zeros(size, bool)
        tokens[: len(ids)], mask[: len(ids)] = ids, True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((tokens, mask), self.schema)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        ids, starts, sizes = zip(*self.index) if self.index else ((), (), ())
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        with self.fs.open_output_stream(temp) as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        self.fs.move(temp, f"{self.path}.index")
        self.fs.move(self.temp, self.path)


class SequenceFile:
    """Random access to the sequences and documents of one file; local files are memory-mapped and nothing is copied."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        local = fs.type_name == "local"
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        with fs.open_input_file(f"{path}.index") as f:
            self.index = pa.ipc.open_file(f).read_all()
        self.length = self.file.schema.field("tokens").type.list_size
        self._at, self._now = -1, None

    def _load(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b != self._at:
            batch = self.file.get_batch(b)
            self._now = tuple(c.values.to_numpy(zero_copy_only=k == 0) for k, c in enumerate(batch.columns))
            self._at = b
        return self._now

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and mask of the i-th sequence: views of the file."""
        tokens, mask = self._load(i // BATCH)
        a = i % BATCH * self.length
        return tokens[a : a + self.length], mask[a : a + self.length]

    def span(self, start: int, n: int) -> np.ndarray:
        """n tokens from position ``start`` of the file's stream."""
        step, parts = BATCH * self.length, []
        while n > 0:
            tokens, _ = self._load(start // step)
            part = tokens[start % step : start % step + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for i, s, n in zip(*(self.index.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens"))):
            yield i, s, self.span(s, n)


def write_token_files(docs: DataFrame, path: str | None = None, *, vocabulary: str | None = None, sequence: int = SEQUENCE, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes ``docs`` and writes Arrow files in ascending id order; returns a manifest (part, file, n_docs, n_tokens, base).

    Part k holds the k-th range of ids; the concatenated parts are the whole token stream, and ``base`` is the number of
    tokens before the part.  Each document ends with id 1.  A file holds record batches of 256 equal-length sequences of ids
    (unsigned 16 bits where the vocabulary allows, else 32) with masks; only the last sequence of a file is padded.  Beside it lies an index of
    its documents.  Null texts count as empty (the end id alone); null ids come first; rows with equal ids keep all their copies, in the
    order of their tokens.  Other columns are ignored; an empty table gives no files.

    Texts never move: ids are encoded in the scan, dealt out by ranges of ids (2 bytes a token) and sorted there.  Files are written under a
    temporary name and renamed, so that a retried task leaves whole files only.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    path = path or fresh_path(spark, "token-files")
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // FILE_DOCUMENTS))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = src.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)] or [0.5], 10_000).alias("b")).first().b if files > 1 else []
    bounds = np.array(sorted(set(bounds or [])), np.int64)

    def make():
        enc = encoder(vocabulary)

        def run(texts: pa.Array) -> list[pa.Array]:
            body, off = utf8(texts)
            rows = enc.encode([bytes(body[a:b]) for a, b in zip(off[:-1], off[1:])])
            return [pa.array(rows, pa.binary())]

        return run

    encoded = append_columns(src, "text", [("ids", T.BinaryType())], make, keep=["doc_id"])
    part = F.lit(0)
    if len(bounds):
        part = F.coalesce(_bucket(F.col("doc_id"), [int(b) for b in bounds]), F.lit(0))
    dealt = encoded.withColumn("part", part.cast("int")).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    schema = "part int, file string, n_docs long, n_tokens long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, now, done = None, None, []
        dtype = encoder(vocabulary).dtype
        _filesystem(path)[0].create_dir(_filesystem(path)[1], recursive=True)

        def finish():
            writer.close()
            done.append((now, name, len(writer.index), writer.total))

        for b in batches:
            for p, d, ids in zip(b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(1)):
                if p != now:
                    if writer:
                        finish()
                    now, name = p, f"{path}/part-{p:06d}.arrow"
                    writer = SequenceWriter(name, dtype, sequence)
                writer.add(d, np.frombuffer(ids.as_buffer(), dtype))
        if writer:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "file", "n_docs", "n_tokens"])

    manifest = cut(dealt.mapInArrow(write, schema), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _bucket(x, bounds: list[int]):
    """The number of bounds below x, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(x.isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = ((i, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, s, ids in SequenceFile(uri).documents())
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("file", "base", "part").repartitionById(parts, F.pmod("part", F.lit(parts))).select("file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
