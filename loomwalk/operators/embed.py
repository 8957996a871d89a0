"""Embeddings: a plug-in point for encoders, a hashed stand-in, and pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An encoder is made once in a worker and turns a list of texts into a float matrix.
Encoder = Callable[[list[str]], np.ndarray]

_encoders: dict[object, Encoder] = {}


def hashed_ngrams(dim: int = 64, n: int = 3) -> Encoder:
    """Signed hashed character n-grams, of unit length: a stand-in where no trained encoder is at hand."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for j in range(len(t) - n + 1):
                h = zlib.crc32(t[j : j + n].encode())
                out[i, (h >> 1) % dim] += 1.0 if h & 1 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    return encode


def embed(docs: DataFrame, make: Callable[[], Encoder], *, key: str, id_col: str = "doc_id", text_col: str = "text", batch: int = 128) -> DataFrame:
    """(id, embedding): ``make`` is called once for each worker and ``key``; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders[key] = make()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                m = np.asarray(_encoders[key]([x or "" for x in part.column(1).to_pylist()]), np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["vec_id", "embedding"])

    return docs.select(F.col(id_col).cast("long").alias("vec_id"), F.col(text_col)).mapInArrow(run, "vec_id long, embedding array<float>")


def mean_pool(tokens: DataFrame, vectors: DataFrame, *, pad: int = 0) -> DataFrame:
    """(doc_id, embedding) of (doc_id, tokens) and (token, v): the mean over tokens that are no pads, without the first place, over ``n + 1e-8``."""
    flat = tokens.select("doc_id", F.posexplode("tokens").alias("pos", "token")).where((F.col("pos") > 0) & (F.col("token") != pad))
    values = flat.join(vectors, "token").select("doc_id", F.posexplode("v").alias("d", "x"))
    # Sums are taken for each dimension before the shuffle; a document's vector is gathered from its dimensions only.
    n = flat.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    dims = values.groupBy("doc_id", "d").agg(F.sum(F.col("x").cast("double")).alias("s")).join(n, "doc_id")
    out = dims.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("d", (F.col("s") / (F.col("n") + 1e-8)).alias("m")))).alias("x"))
    return out.select("doc_id", F.col("x.m").alias("embedding"))


def first_place(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, embedding): the vector of the first token."""
    return tokens.select("doc_id", F.col("tokens")[0].alias("token")).join(vectors, "token").select("doc_id", F.col("v").alias("embedding"))
