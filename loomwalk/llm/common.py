"""Shared plumbing: the shared folder, lineage cuts, Arrow passes and fixed-size bitmaps."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of one Arrow batch handed to a Python worker; a single longer row still travels whole.
BATCH_BYTES = 16 << 20
#: Bytes of text that a kernel works on at a time.
SLICE_BYTES = 1 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, one of our own, if all run on this machine."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints/loomwalk"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    if not _made:
        atexit.register(cleanup)
    path = f"{shared_dir(spark)}/loomwalk-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cleanup() -> None:
    """Deletes every table that this driver has written to the shared folder."""
    while _made:
        spark, path = _made.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit
            return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts cannot fill a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not str(spark.conf.get(key)).rstrip("b").isdigit() or int(str(spark.conf.get(key)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on, and its later tasks may need little while the JVM needs more."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def slices(batches: Iterator[pa.RecordBatch], text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of text, or one row."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b.column(text_at).nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    *,
    keep: list[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One narrow Arrow pass: ``make()`` builds, once per task, a function from the text array to the new columns.

    ``keep`` names the input columns that stay (all by default).  An input column which has the name of a new
    column is replaced by it, so extra columns with clashing names do no harm.  ``slice_bytes`` of text are worked on at a time.
    """
    bounded_batches(df.sparkSession)
    new = {n for n, _ in fields}
    names = [c for c in (df.columns if keep is None else keep) if c not in new]
    # Plain names inside: a name with a dot can't be handed to the Arrow pass.
    src = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType(list(src.schema)[: len(names)] + [T.StructField(f"n{i}", t) for i, (_, t) in enumerate(fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in slices(batches, len(names), slice_bytes):
            if b.num_rows:
                cols = [b.column(i) for i in range(len(names))] + list(f(b.column(len(names))))
                yield pa.RecordBatch.from_arrays([c.cast(x.type) if c.type != x.type else c for c, x in zip(cols, arrow)], schema=arrow)
        give_back()

    return src.mapInArrow(run, schema).toDF(*names, *[n for n, _ in fields])


#: A bitmap has so many bits, as powers of two: 32 for each key, up to a bound of 128 MB.
LEAST_BITS, MOST_BITS = 16, 30


def bitmap_bits(keys: int, most: int = MOST_BITS) -> int:
    """The size of a bitmap for so many keys.  Beyond the bound more other rows pass; none that should is lost."""
    return min(most, max(LEAST_BITS, (32 * max(1, keys) - 1).bit_length()))


def bitmap_of(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Rows (bucket, bitmap): a membership bitmap of 2**bits bits over hashed keys, at most 2**bits / 8 bytes in all.

    It is an array of 32-bit words, shifted by 2**31 to fit an int: the test then is a look-up in generated code."""
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    made = (
        keys.select(slot.alias("v"))
        .groupBy(F.bitmap_bucket_number("v").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bitmap"))
    )
    word = lambda i: (F.conv(F.hex(F.substring("bitmap", i, F.lit(4))), 16, 10).cast("long") - (1 << 31)).cast("int")
    return made.select("bucket", F.transform(F.sequence(F.lit(1), F.octet_length("bitmap"), F.lit(4)), word).alias("bitmap"))


def flag_in(df: DataFrame, key: Column, keys: DataFrame, of: Column, *, name: str = "__maybe", most_bits: int = MOST_BITS) -> DataFrame:
    """``df`` with a boolean: whether its key may be among the keys ``of`` (no false negatives).

    ``keys`` is a written table, whose rows are counted; the bitmap that is broadcast has a size by that number, bounded by ``most_bits``."""
    bits = bitmap_bits(keys.count(), most_bits)
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    bm = bitmap_of(keys, of, bits).select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))
    pos = F.bitmap_bit_position(slot)
    word = F.get("__bitmap", F.shiftright(pos, 5).cast("int")).cast("long") + F.lit(1 << 31)
    bit = (pos.bitwiseAND(F.lit(31).cast("long")).bitwiseXOR(F.lit(24).cast("long"))).cast("int")  # bytes of a word come largest first
    hit = F.getbit(word, bit) == 1
    return df.join(F.broadcast(bm), F.bitmap_bucket_number(slot) == F.col("__bucket"), "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("__bucket", "__bitmap")


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, of: Column, *, most_bits: int = MOST_BITS) -> DataFrame:
    """Rows whose key may be among ``keys``: what stands in front of an exact join, so that the other rows are not shuffled."""
    return flag_in(df, key, keys, of, most_bits=most_bits).where("__maybe").drop("__maybe")


def utf8(texts: pa.Array) -> tuple[memoryview, "object"]:
    """The bytes of a string array and its offsets (int64, from 0), nulls as empty."""
    import numpy as np

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_utf8())
    if not len(texts):
        return memoryview(b""), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = memoryview(data)[off[0] : off[-1]] if data is not None else memoryview(b"")
    return body, off - off[0]
