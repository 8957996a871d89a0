"""Nearest neighbours of vectors: exact in blocks, and approximate by an inverted file of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import bounded_batches, fresh_path

#: Values of one side of a block: 4 M floats are 16 MB.
BLOCK_VALUES = 1 << 22
DIGITS = 6


def cell_count(n: int) -> int:
    """Cells of an index over ``n`` vectors; the boundary values themselves fall to the last branch."""
    if n < 1_000_000:
        return int(8 * math.sqrt(n))
    if 1_000_000 < n < 10_000_000:
        return 65_536
    if 10_000_000 < n < 100_000_000:
        return 262_144
    return 1_048_576


def training_rows(n: int) -> int:
    return min(64 * cell_count(n), n)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _blocks(x: np.ndarray, columns: int) -> Iterator[np.ndarray]:
    """Rows of ``x``, so many at a time that a product with ``columns`` others stays within BLOCK_VALUES."""
    step = max(1, BLOCK_VALUES // max(1, columns))
    for i in range(0, len(x), step):
        yield x[i : i + step]


#: Vectors of one packed row, and of the index that are multiplied at a time; queries that are multiplied at a time; the least queries of a task.
PACK_ROWS, INDEX_ROWS, QUERY_ROWS, TASK_ROWS = 1024, 4096, 512, 2048
#: Vectors longer than this, or not finite, are scored in double precision only.
TAME = 1e15


class Nearest:
    """The ``k`` nearest of a block of queries, kept while the index passes by in any order and in pieces of any size.

    A product in single precision finds what can be among the ``k`` at all: its error is bounded by the lengths of the vectors, and what comes within
    that bound of the worst of the ``k`` is scored in double precision, rounded and ranked (ties: smaller id).  So the result is that of double precision."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, groups: list | None, k: int, metric: str, same_id: bool):
        if metric not in ("ip", "l2"):
            raise ValueError(f"unknown metric {metric}")
        self.ids, self.v, self.k, self.l2, self.same_id = ids, v, k, metric == "l2", same_id
        self.code = {g: i for i, g in enumerate(dict.fromkeys(groups))} if groups is not None else None
        self.groups = np.array([self.code[g] for g in groups], np.int64) if groups is not None else None
        self.score, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        self.wild = ~(self.norm < TAME)
        ones = np.ones((len(v), 1), np.float32)
        self.left = np.concatenate([v, ones], axis=1) if self.l2 else v

    def feed(self, ids: np.ndarray, v: np.ndarray, groups: list | None) -> None:
        with np.errstate(all="ignore"):
            for i in range(0, len(ids), INDEX_ROWS):
                self._feed(ids[i : i + INDEX_ROWS], v[i : i + INDEX_ROWS], groups[i : i + INDEX_ROWS] if groups is not None else None)

    def _feed(self, ids: np.ndarray, v: np.ndarray, groups: list | None) -> None:
        squares = (v.astype(np.float64) ** 2).sum(1)
        wild = ~(squares < TAME * TAME)
        right = np.concatenate([v, (-squares / 2).astype(np.float32)[:, None]], axis=1) if self.l2 else v
        of = np.array([self.code.get(g, -1) for g in groups], np.int64) if self.code is not None else None
        longest = np.sqrt(squares[~wild].max(initial=0))
        for i in range(0, len(self.ids), QUERY_ROWS):
            at = slice(i, min(i + QUERY_ROWS, len(self.ids)))
            s = self.left[at] @ right.T
            if wild.any():
                s[:, wild] = -np.inf
            if of is not None:
                s[self.groups[at][:, None] == of[None, :]] = -np.inf
            size = self.norm[at]
            error = (v.shape[1] + 8) * 2.0**-24 * (size * longest + (longest**2 / 2 if self.l2 else 0)) + 1e-6 + (1e-12 * size**2 if self.l2 else 0)
            worst = self.score[at, -1]
            least = ((worst + size**2) / 2 if self.l2 else worst) - error
            few = np.flatnonzero(worst == -np.inf)
            if len(few) and len(ids) > self.k:  # no bound yet: the k-th of this piece is one
                t = s[few]
                if self.same_id:
                    t[self.ids[at][few][:, None] == ids[None, :]] = -np.inf
                least[few] = np.partition(t, len(ids) - self.k, axis=1)[:, -self.k] - 2 * error[few]
            least[self.wild[at]] = -np.inf
            least = np.maximum(np.nextafter(least.astype(np.float32), np.float32(-np.inf)), np.finfo(np.float32).min)
            if wild.any():
                s[:, wild] = np.inf
            if self.wild[at].any():
                s[self.wild[at]] = np.inf
            rows = np.flatnonzero(s.max(axis=1) >= least)
            if len(rows):
                r, c = np.nonzero(s[rows] >= least[rows, None])
                r = rows[r] + i
                for j in range(0, len(r), 1 << 16):
                    self._take(r[j : j + (1 << 16)], c[j : j + (1 << 16)], ids, v, of)

    def _take(self, r: np.ndarray, c: np.ndarray, ids: np.ndarray, v: np.ndarray, of: np.ndarray | None) -> None:
        ok = np.ones(len(r), bool)
        if self.same_id:
            ok &= self.ids[r] != ids[c]
        if of is not None:
            ok &= self.groups[r] != of[c]
        r, c = r[ok], c[ok]
        a, b = self.v[r].astype(np.float64), v[c].astype(np.float64)
        score = np.round(-((a - b) ** 2).sum(1) if self.l2 else (a * b).sum(1), DIGITS)
        n, worst = ids[c], self.score[r, -1]
        ok = (score > worst) | (score == worst) & (score > -np.inf) & (n < self.found[r, -1])
        r, n, score = r[ok], n[ok], score[ok]
        if not len(r):
            return
        u, own = np.unique(r, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(u)), self.k), own])
        score, n = np.concatenate([self.score[u].ravel(), score]), np.concatenate([self.found[u].ravel(), n])
        order = np.lexsort((n, -score, row))
        top = order[np.searchsorted(row[order], np.arange(len(u)))[:, None] + np.arange(self.k)]
        self.score[u], self.found[u] = score[top], n[top]

    def result(self, step: int = 1 << 13) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), step):
            score, n = self.score[i : i + step], self.found[i : i + step]
            ok = score > -np.inf
            q = np.broadcast_to(self.ids[i : i + step, None], score.shape)
            yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(n[ok]), pa.array(score[ok])], names=["q", "n", "score"])


def _packed(df: DataFrame, id_col: str, vector_col: str, group_col: str | None, block_values: int, name: str) -> DataFrame:
    """(at, size, width, ids, v, g): vectors, many to a row, as bytes; written to the shared folder."""
    g = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    src = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), g.alias("g"), F.col(vector_col).cast("array<float>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            width = len(b.column(2).flatten()) // max(1, b.num_rows)
            step = max(1, min(PACK_ROWS, block_values // max(1, width)))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                row = [[at], [part.num_rows], [width], [part.column(0).to_numpy().astype(np.int64).tobytes()], [v.reshape(part.num_rows, width).tobytes()], [part.column(1).to_pylist() if group_col else None]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())))], names=["at", "size", "width", "ids", "v", "g"])
                at += 1

    schema = "at long, size long, width long, ids binary, v binary, g array<string>"
    rows = src.mapInArrow(pack, schema).withColumn("at", F.col("at") + F.spark_partition_id())  # the partitions begin at different blocks
    path = fresh_path(df.sparkSession, name)
    rows.write.option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def exact_knn(queries: DataFrame, index: DataFrame, k: int, *, metric: str = "ip", same_id: bool = True, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """The ``k`` nearest vectors of each query: (q, n, rank from 1, score).

    ``metric``: ``ip`` (inner product, largest first) or ``l2`` (squared distance, smallest first).  Scores are rounded to six digits
    and ties go to the smaller id.  With ``same_id`` queries and index share ids and a vector is no neighbour of itself; with ``group_col``
    neighbours of the same group do not count.  Null vectors are left out.

    Queries are dealt into blocks of bounded size, one to a task, and the index streams through each of them in pieces; a task holds its block, the ``k`` best of
    each of its queries and a piece of the index.  There are as many blocks as keep all cores busy, more only where blocks would exceed ``block_values``, so
    the index moves as often as there are cores.  No side is broadcast or collected.
    """
    bounded_batches(queries.sparkSession)
    q = _packed(queries, id_col, vector_col, group_col, block_values, "knn-queries")
    x = q if index is queries else _packed(index, id_col, vector_col, group_col, block_values, "knn-index")
    rows, values = q.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("width")), F.lit(0))).first()
    blocks = max(1, -(-values // block_values), min(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    own = q.select(F.lit(0).alias("side"), F.pmod("at", F.lit(blocks)).cast("int").alias("block"), "width", "ids", "v", "g")
    every = x.select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "width", "ids", "v", "g")
    dealt = own.unionByName(every).repartitionById(blocks, "block").sortWithinPartitions("side")
    grouped = group_col is not None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries come first."""
        held, many, near = ([], [], []), 0, None

        def taken() -> tuple[np.ndarray, np.ndarray, list | None]:
            out = np.concatenate(held[0]), np.concatenate(held[1]), [g for part in held[2] for g in part] if grouped else None
            for part in held:
                part.clear()
            return out

        for b in batches:
            for side, width, ids, v, g in zip(*(b.column(i) for i in (0, 2, 3, 4, 5))):
                if side.as_py() and near is None:
                    if not held[0]:
                        return
                    near, many = Nearest(*taken(), k, metric, same_id), 0
                held[0].append(np.frombuffer(ids.as_py(), np.int64))
                held[1].append(np.frombuffer(v.as_py(), np.float32).reshape(-1, width.as_py()))
                if grouped:
                    held[2].append(g.as_py())
                many += len(held[0][-1])
                if near is not None and many >= INDEX_ROWS:
                    near.feed(*taken())
                    many = 0
        if near is not None:
            if many:
                near.feed(*taken())
            yield from near.result()

    return best(dealt.mapInArrow(search, "q long, n long, score double"), k, metric)


def best(candidates: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """(q, n, rank, score): the k best of each query's candidates (q, n, score with larger nearer)."""
    order = W.partitionBy("q").orderBy(F.col("score").desc(), "n")
    shown = F.col("score") if metric == "ip" else F.col("score") * -1 + 0.0
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "n", "rank", shown.alias("score"))


def compact(knn: DataFrame) -> DataFrame:
    """(q, nn): the neighbours of each query in the order of their ranks."""
    return knn.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("x")).select("q", F.col("x.n").alias("nn"))


def reference_knn(knn: DataFrame, k: int, same: DataFrame) -> DataFrame:
    """(q, rank, n): of wider neighbour lists (q, rank, n), the first ``k`` outside of the query's own document; ``same`` is (id, doc)."""
    a = same.select(F.col("id").alias("q"), F.col("doc").alias("dq"))
    b = same.select(F.col("id").alias("n"), F.col("doc").alias("dn"))
    kept = knn.join(a, "q").join(b, "n").where("dq <> dn")
    rank = F.row_number().over(W.partitionBy("q").orderBy("rank"))
    return kept.withColumn("r", rank).where(F.col("r") <= k).select("q", F.col("r").alias("rank"), "n")


# --- inverted file ---------------------------------------------------------------------------------------------
def train_cells(index: DataFrame, cells: int, *, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 1 << 16, rounds: int = 10) -> np.ndarray:
    """Centroids by spherical k-means over a bounded sample: the ``sample`` vectors whose ids have the least hashes."""
    rows = index.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    table = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = _matrix(table["v"]) if len(table) else np.zeros((1, 1))
    centre = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ centre.T, axis=1) for part in _blocks(x, len(centre))])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 0, total / np.maximum(size, 1e-12), centre)
    return centre


def assign_cells(df: DataFrame, centre: np.ndarray, probes: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, cell): a row for each of the ``probes`` nearest cells of a vector.  The centroids are a bounded broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = min(probes, len(shared.value))
                top = np.concatenate([np.argsort(-(part @ shared.value.T), axis=1, kind="stable")[:, :p] for part in _blocks(_matrix(b.column(1)), len(shared.value))]).astype(np.int32)
                at = pa.array(np.repeat(np.arange(b.num_rows), p))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(top.ravel())], names=["id", "v", "cell"])

    src = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    return src.mapInArrow(run, "id long, v array<float>, cell int")


def ivf_knn(queries: DataFrame, index: DataFrame, k: int, *, cells: int | None = None, probes: int = 32, same_id: bool = True, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 1 << 14) -> DataFrame:
    """Approximate ``exact_knn`` by inner product: every vector is indexed under its nearest cell, a query looks into its ``probes`` nearest cells.

    Cells and parts of cells are matrix products: a cell of more than ``most`` vectors is dealt into parts, and its queries go to each part.
    """
    n = index.count()
    centre = train_cells(index, cells or max(1, cell_count(n) // 8), id_col=id_col, vector_col=vector_col)
    x = assign_cells(index, centre, 1, id_col=id_col, vector_col=vector_col)
    parts = x.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    x = x.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("cell", "part", "id", "v", F.lit(False).alias("is_q"))
    q = assign_cells(queries, centre, probes, id_col=id_col, vector_col=vector_col).join(parts, "cell")
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", "id", "v", F.lit(True).alias("is_q"))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_q = table["is_q"].combine_chunks()
        left, right = table.filter(is_q), table.filter(pc.invert(is_q))
        vectors = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(t), -1)
        out = []
        if len(left) and len(right):
            v, ids, asked = vectors(right), right["id"].to_numpy(), vectors(left)
            for i in range(0, len(left), TASK_ROWS):
                near = Nearest(left["id"].to_numpy()[i : i + TASK_ROWS], asked[i : i + TASK_ROWS], None, k, "ip", same_id)
                near.feed(ids, v, None)
                out.extend(near.result())
        return pa.Table.from_batches(out, pa.schema([("q", pa.int64()), ("n", pa.int64()), ("score", pa.float64())]))

    found = q.unionByName(x).groupBy("cell", "part").applyInArrow(search, "q long, n long, score double")
    return best(found, k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (queries, hits, recall): the share of the true neighbours (q, n) that were found."""
    hit = truth.select("q", "n").join(found.select("q", "n", F.lit(1).alias("hit")), ["q", "n"], "left")
    return hit.agg(F.countDistinct("q").alias("queries"), F.count("hit").alias("hits"), F.round(F.try_divide(F.count("hit"), F.count(F.lit(1))), 6).alias("recall"))


# --- stored index of cells and codes -----------------------------------------------------------------------------
#: Values that a code's part can have: a byte.
CODES = 256


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(1) / 2
    return np.concatenate([np.argmax(part @ centre.T - half, axis=1) for part in _blocks(x, len(centre))]) if len(x) else np.zeros(0, int)


def train_codes(x: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """(parts, CODES, width) centroids of the parts of vectors, by k-means."""
    width = x.shape[1] // parts
    out = np.zeros((parts, CODES, width))
    for p in range(parts):
        y = x[:, p * width : (p + 1) * width]
        centre = y[np.linspace(0, len(y) - 1, CODES).astype(int)].copy()
        for _ in range(rounds):
            near = _nearest(y, centre)
            n = np.bincount(near, minlength=CODES)
            total = np.zeros_like(centre)
            np.add.at(total, near, y)
            centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        out[p] = centre
    return out


def build_index(index: DataFrame, path: str, *, cells: int | None = None, parts: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 1 << 16) -> None:
    """Writes an index: ``vectors`` (cell, id, code), a byte for each of ``parts`` of what a vector differs from its cell's centroid by, in folders by cell group; and
    ``model`` (kind, k, values), the centroids of cells and codes.

    Centroids come from a bounded sample; all vectors are coded in one pass over them.  Widths are a multiple of ``parts``."""
    spark = index.sparkSession
    n = index.count()
    centre = train_cells(index, cells or max(1, cell_count(n) // 8), id_col=id_col, vector_col=vector_col, sample=min(sample, training_rows(n)))
    rows = index.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    x = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(min(sample, training_rows(n))).toArrow()["v"])
    x = x - centre[np.concatenate([np.argmax(part @ centre.T, axis=1) for part in _blocks(x, len(centre))])]
    codes = train_codes(x, parts)
    shared = spark.sparkContext.broadcast((centre, codes))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, codes = shared.value
        width = codes.shape[2]
        for b in batches:
            if b.num_rows:
                cell = b.column(2).to_numpy()
                rest = _matrix(b.column(1)) - centre[cell]
                out = np.stack([_nearest(rest[:, p * width : (p + 1) * width], codes[p]) for p in range(len(codes))], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([r.tobytes() for r in out], pa.binary())], names=["cell", "id", "code"])

    coded = assign_cells(index, centre, 1, id_col=id_col, vector_col=vector_col).mapInArrow(code, "cell int, id long, code binary")
    coded.withColumn("cells", F.floor(F.col("cell") / 256).cast("int")).repartition("cells", "cell").sortWithinPartitions("cells", "cell", "id").write.partitionBy("cells").mode("overwrite").parquet(f"{path}/vectors")
    model = [("cell", i, c.tolist()) for i, c in enumerate(centre)] + [("code", p * CODES + i, c.tolist()) for p in range(parts) for i, c in enumerate(codes[p])]
    spark.createDataFrame(model, "kind string, k int, values array<double>").write.mode("overwrite").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The centroids of cells and of codes; their number is bounded by :func:`cell_count` and the parts of a code."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "k").toArrow()
    kind = np.array(rows["kind"].to_pylist())
    values = rows["values"].combine_chunks()
    cells, codes = (np.array(values.filter(pa.array(kind == k)).to_pylist()) for k in ("cell", "code"))
    return cells, codes.reshape(-1, CODES, codes.shape[1])


def search_index(queries: DataFrame, path: str, k: int, *, probes: int = 32, refine: int = 8, vectors: DataFrame | None = None, same_id: bool = True, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 1 << 16) -> DataFrame:
    """Approximate ``exact_knn`` by inner product over a stored index: (q, n, rank, score).

    A query looks into its ``probes`` nearest cells; scores of codes are sums of table look-ups.  With ``vectors`` the best ``refine * k`` of each query are
    scored anew by the vectors themselves.  Large cells are dealt into parts; queries go to each part."""
    spark = queries.sparkSession
    centre, codes = load_model(spark, path)
    shared = spark.sparkContext.broadcast((centre, codes))
    x = spark.read.parquet(f"{path}/vectors").select("cell", "id", "code")
    parts = x.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    x = x.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "code", F.lit(None).cast("array<float>").alias("v"))
    q = assign_cells(queries, centre, probes, id_col=id_col, vector_col=vector_col).join(parts, "cell")
    q = q.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", F.lit(None).cast("binary").alias("code"), "v")
    wide = k * (refine if vectors is not None else 1)

    def search(table: pa.Table) -> pa.Table:
        centre, codes = shared.value
        asked = np.array([c is None for c in table["code"].to_pylist()])
        left, right = table.filter(pa.array(asked)), table.filter(pa.array(~asked))
        out = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if len(left) and len(right):
            right = right.sort_by("id")
            ids, code = right["id"].to_numpy(), np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(right), -1)
            at, width = centre[left["cell"][0].as_py()], codes.shape[2]
            for own, v in zip(left["id"].to_pylist(), _matrix(left["v"])):
                look = np.stack([codes[p] @ v[p * width : (p + 1) * width] for p in range(len(codes))])
                s = look[np.arange(len(codes))[None, :], code].sum(axis=1) + at @ v
                if same_id:
                    s[ids == own] = -np.inf
                top = np.argsort(-s, kind="stable")[:wide]
                top = top[s[top] > -np.inf]
                for to, c in zip(out, (np.full(len(top), own), ids[top], np.round(s[top], DIGITS))):
                    to.append(c)
        return pa.table({n: np.concatenate(c) for n, c in zip(("q", "n", "score"), out)})

    found = best(q.unionByName(x).groupBy("cell", "part").applyInArrow(search, "q long, n long, score double"), wide)
    if vectors is None:
        return found
    side = lambda df, name, v: df.select(F.col(id_col).cast("long").alias(name), F.col(vector_col).alias(v))
    both = found.select("q", "n").join(side(vectors, "n", "b"), "n").join(side(queries, "q", "a"), "q")
    product = F.aggregate(F.zip_with("a", "b", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return best(both.select("q", "n", F.round(product, DIGITS).alias("score")), k)
