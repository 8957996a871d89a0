"""Readers of corpora, arrays and small formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import running_sum


def jsonl(spark: SparkSession, path: str, *, text_key: str = "text", schema: T.StructType | None = None, pattern: str | None = None) -> DataFrame:
    """JSON lines below ``path``: (file, text, ...), other keys as they are.  With a schema the files are read once; without, twice."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(F.col("_metadata.file_name").alias("file"), F.col(f"`{text_key}`").alias("text"), *[F.col(f"`{c}`") for c in df.columns if c != text_key])


def shards(spark: SparkSession, folder: str, domain: str) -> DataFrame:
    """(file_id, pos, line): the lines of ``{domain}.chunk.{NN}.jsonl``, by shard number and place.

    A file is not split, so that places are line numbers; shards are meant to be of moderate size."""
    lines = spark.read.option("pathGlobFilter", f"{domain}.chunk.*.jsonl").text(folder, wholetext=True)
    file_id = F.regexp_extract("_metadata.file_name", r"\.chunk\.(\d+)\.jsonl$", 1).cast("int")
    return lines.select(file_id.alias("file_id"), F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("pos", "line"))


def documents(spark: SparkSession, folder: str, domain: str) -> DataFrame:
    """(doc_id, file_id, pos, text): ids run over the shards in their order."""
    lines = shards(spark, folder, domain)
    counts = running_sum(lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")), F.col("n"), "file_id", out="first")
    return lines.join(counts.select("file_id", "first"), "file_id").select((F.col("first") + F.col("pos")).alias("doc_id"), "file_id", "pos", F.from_json("line", "text string")["text"].alias("text"))


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(file, text): each file is one document."""
    return spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def titled(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="title string, text string", quote="")


#: Rows of an array file that one task reads at a time.
RANGE_ROWS = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system.open_input_file(path)


def _layout(uri: str, size: int, dtype: str, width: int) -> tuple[int, str, int, int]:
    """(offset of the values, their type, values in a row, rows) of a file: as its header says, or as given where it has none."""
    offset, kind, columns = 0, np.dtype(dtype), width
    with _open(uri) as f:
        if f.read(6) == b"\x93NUMPY":
            f.seek(0)
            version = np.lib.format.read_magic(f)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if fortran or not shape or len(shape) > 2:
                raise ValueError(f"{uri}: an array of shape {shape} in this order has no rows")
            offset, columns = f.tell(), int(np.prod(shape[1:], dtype=int))
    values = size - offset
    if values <= 0 or columns <= 0 or values % (kind.itemsize * columns):
        raise ValueError(f"{uri}: {values} bytes are no rows of {columns}")
    return offset, kind.str, columns, values // (kind.itemsize * columns)


def binary_arrays(spark: SparkSession, path: str, dtype: str, width: int, *, pattern: str = "*", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(file, row, values) of array files of fixed width: with a header that names type and shape, or raw, ``width`` values a row.  A size that is no multiple of a
    row is an error.

    Only names and sizes of files are listed; tasks read ranges of ``range_rows`` rows, so a file may have any size.  Files must be in a store that Arrow reads."""
    kind = np.dtype(dtype)
    element = {"f": ("double", pa.float64()), "i": ("bigint", pa.int64()), "u": ("bigint", pa.int64())}[kind.kind]
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                offset, found, columns, rows = _layout(name, size, dtype, width)
                first = pa.array(range(0, rows, range_rows), pa.int64())
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), first, pa.array([rows] * n), pa.array([offset] * n), pa.array([found] * n), pa.array([columns] * n)], names=["path", "first", "rows", "offset", "kind", "columns"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first, rows, offset, found, columns in zip(*(c.to_pylist() for c in b.columns)):
                step = np.dtype(found)
                with _open(name) as f:
                    for i in range(first, min(rows, first + range_rows), 4096):
                        n = min(4096, rows - i, first + range_rows - i)
                        f.seek(offset + i * columns * step.itemsize)
                        flat = np.frombuffer(f.read(n * columns * step.itemsize), step)
                        values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, columns, dtype=np.int32)), pa.array(flat.astype(step.newbyteorder("="))).cast(element[1]))
                        yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]] * n), pa.array(np.arange(i, i + n)), values], names=["file", "row", "values"])

    dealt = files.mapInArrow(ranges, "path string, first long, rows long, offset long, kind string, columns long").repartition("path", "first")
    return dealt.mapInArrow(read, f"file string, row long, values array<{element[0]}>")


def knn_shards(spark: SparkSession, path: str, width: int, *, dtype: str = "int64") -> DataFrame:
    """(q, rank, n) of neighbour files ``I{first row}_*.npy``: ranks from 0, missing neighbours (negative) left out."""
    raw = binary_arrays(spark, path, dtype, width, pattern="I*")
    first = F.regexp_extract("file", r"^I(\d+)", 1).cast("long")
    return raw.select((first + F.col("row")).alias("q"), F.posexplode("values").alias("rank", "n")).where("n >= 0")


def reshape(flat: DataFrame, width: int) -> DataFrame:
    """(row, values) of (pos, value); the number of values must be a multiple of ``width`` and not zero."""
    n = flat.count()
    if not n or n % width:
        raise ValueError(f"{n} values are no rows of {width}")
    rows = flat.groupBy(F.floor(F.col("pos") / width).cast("long").alias("row")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x"))
    return rows.select("row", F.col("x.value").alias("values"))


def counted_shards(spark: SparkSession, path: str, extension: str = "tfrecord") -> DataFrame:
    """(file, n): record counts that the file names hold, ``...-{shard}-{count}.{extension}``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), F.regexp_extract(name, rf"-\d+-(\d+)\.{extension}$", 1).cast("long").alias("n"))


def relevance(rows: DataFrame) -> DataFrame:
    """(question, titles) of (question, positive_ctxs: array of structs with a title): titles joined by tabs."""
    return rows.select("question", F.array_join(F.transform("positive_ctxs", lambda x: x["title"]), "\t").alias("titles"))


def preview(docs: DataFrame, limit: int, *, order_col: str = "doc_id") -> DataFrame:
    """The first rows of a corpus: a top-n."""
    return docs.orderBy(order_col).limit(limit)


def conll(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, pos, word, label): blank and ``-DOCSTART-`` lines end a record; a missing label is ``O``."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    brk = (F.trim("line") == "") | F.startswith("line", F.lit("-DOCSTART-"))
    w = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("b", brk.cast("int")).withColumn("record", F.sum("b").over(w)).where("b = 0")
    cells = F.split("line", " ")
    return rows.select("file", "record", F.col("line_no").alias("pos"), cells[0].alias("word"), F.when(F.size(cells) > 1, F.element_at(cells, -1)).otherwise("O").alias("label"))
