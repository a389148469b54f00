"""Latent semantic vectors: truncated singular value decomposition of sparse rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.mllib.linalg import Vectors, VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.scratch import scratch
from .ranking import ranked

#: Cells of a part of the rows or terms, about (a quarter, for the first parts); how many are first; most parts; most vectors of a basis, in multiples of what is asked for.
CELLS, FIRST, PARTS, BASIS = 1 << 19, 16, 256, 16
#: Residual, over its eigenvalue, at which a vector has converged, and least residual, over the largest one; length of directions that count as none, over the largest.
TOLERANCE, LEAST, NOTHING = 1e-10, 1e-14, 1e-7


def indexed_terms(vocab: DataFrame) -> DataFrame:
    """term, index in term order."""
    return ranked(vocab.select("term"), ["term"], "index").withColumn("index", F.col("index").cast("int"))


def fit_svd(weights: DataFrame, terms: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, term vectors [terms, k]) of (row, term, weight); the rows stay distributed, nothing is centred."""
    width = terms.count()
    rows = weights.join(terms, "term").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("index", "weight"))).alias("cells"))  # a row's cells are bounded by its text
    vectors = rows.rdd.map(lambda r: (Vectors.sparse(width, [(c["index"], c["weight"]) for c in r["cells"]]),))
    # the decomposition goes over the rows hundreds of times: they are made once, and kept outside of Python
    held = rows.sparkSession.createDataFrame(vectors, StructType([StructField("vector", VectorUDT())])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = RowMatrix(held, numCols=width).computeSVD(k)
        return np.array(found.s.toArray()), np.array(found.V.toArray())
    finally:
        held.unpersist()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, weight, v) in the order of ids -> id, vector: the weighted sum of each id's; an id may span batches."""

    def row(ids: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(sums), pa.list_(pa.float64()))], names=["id", "vector"])

    last: tuple[int, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) * batch.column(1).to_numpy()[:, None]
        cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids, sums = ids[cut], np.add.reduceat(v, cut, axis=0)
        if last is not None:
            if last[0] == ids[0]:
                sums[0] += last[1]
            else:
                yield row(np.array([last[0]]), last[1][None])
        if len(ids) > 1:
            yield row(ids[:-1], sums[:-1])
        last = int(ids[-1]), sums[-1]
    if last is not None:
        yield row(np.array([last[0]]), last[1][None])


def project(weights: DataFrame, terms: DataFrame, v: np.ndarray) -> DataFrame:
    """id (bigint), vector: rows times the term vectors; terms join with their vectors and are added up by numpy, first within each partition."""
    spark = weights.sparkSession
    names = [r.term for r in terms.orderBy("index").collect()]  # as many as `v` has rows, which is on the driver already
    table = spark.createDataFrame([(t, x.tolist()) for t, x in zip(names, v, strict=True)], "term string, v array<double>")
    rows = weights.join(table, "term").select(F.col("id").cast("bigint").alias("id"), "weight", "v")
    parts = rows.sortWithinPartitions("id").mapInArrow(_added, "id bigint, vector array<double>")
    parts = parts.select("id", F.lit(1.0).alias("weight"), "vector").repartition("id").sortWithinPartitions("id")
    return parts.mapInArrow(_added, "id bigint, vector array<double>")


class _Shelf:
    """Matrices in the shared folder, in parts by number."""

    def __init__(self, path: str):
        self.path = path

    def _file(self, name: str, part: int) -> tuple[fs.FileSystem, str]:
        store, top = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{top}/{name}")
        return store, f"{top}/{name}/{part}"

    def put(self, name: str, part: int, x: np.ndarray) -> None:
        store, where = self._file(name, part)
        with store.open_output_stream(where) as out:
            out.write(np.ascontiguousarray(x).data.cast("B") if x.size else b"")

    def get(self, name: str, part: int, width: int) -> np.ndarray:
        store, where = self._file(name, part)
        with store.open_input_file(where) as opened:
            return np.frombuffer(opened.read_buffer(), np.float64).reshape(-1, width)

    def drop(self, name: str) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        store.delete_dir(f"{top}/{name}")

    def cells(self, name: str, part: int) -> Iterator[pa.RecordBatch]:
        """Batches (other, i, j, weight) of a part, in the order of (other, i) within a file."""
        store, top = fs.FileSystem.from_uri(self.path)
        where = f"{top}/{name}/part={part}"
        if store.get_file_info(where).type == fs.FileType.NotFound:
            return
        for f in sorted(f.path for f in store.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet")):
            with store.open_input_file(f) as opened:
                yield from pq.ParquetFile(opened).iter_batches(1 << 15, columns=["other", "i", "j", "weight"])


class _Sparse:
    """Cells of a matrix, written twice: in parts of its rows and in parts of its columns, each of about CELLS."""

    def __init__(self, cells: DataFrame, n: int, width: int):
        """cells: at (below n), index (below width), weight; each place once."""
        self.spark: SparkSession = cells.sparkSession
        self.path = scratch(self.spark, "sparse")
        self.shelf, self.n = _Shelf(self.path), n
        many = cells.count()
        parts = max(1, min(4 * many // CELLS, FIRST), min(many // CELLS, PARTS))
        self.high, self.wide = -(-n // min(parts, n)), -(-width // min(parts, width))
        self.rows, self.columns = -(-n // self.high), -(-width // self.wide)
        for name, own, size, other, step in (("rows", "at", self.high, "index", self.wide), ("columns", "index", self.wide, "at", self.high)):
            place = lambda c, s: (F.floor(F.col(c) / s).cast("int"), (F.col(c) % s).cast("int"))
            (part, i), (across, j) = place(own, size), place(other, step)
            tiles = cells.select(part.alias("part"), across.alias("other"), i.alias("i"), j.alias("j"), F.col("weight").cast("double").alias("weight"))
            tiles.repartition(parts, "part").sortWithinPartitions("part", "other", "i").write.partitionBy("part").parquet(f"{self.path}/{name}")

    def __getstate__(self) -> dict:
        return {**self.__dict__, "spark": None}  # tasks take the rest

    def each(self, parts: int, run: Callable[[int], np.ndarray | None]) -> list[np.ndarray]:
        """A task for each part; what they give, small matrices, in the order of parts."""

        return self.spark.sparkContext.range(0, parts, 1, parts).map(run).collect()

    def times(self, side: str, part: int, name: str, width: int) -> np.ndarray:
        """A part of the matrix (of its transposed, by columns) times what is shelved as `name`."""
        size = min(self.high, self.n - part * self.high) if side == "rows" else self.wide
        out, last, x = np.zeros((size, width)), None, None
        for batch in self.shelf.cells(side, part):
            other, i, j, w = (batch.column(k).to_numpy() for k in range(4))
            cuts = np.flatnonzero(np.append(True, other[1:] != other[:-1])).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(other)], strict=True):
                if other[lo] != last:
                    last = other[lo]
                    x = self.shelf.get(name, int(last), width)
                first = np.flatnonzero(np.append(True, i[lo + 1 : hi] != i[lo : hi - 1]))
                out[i[lo:hi][first]] += np.add.reduceat(x[j[lo:hi]] * w[lo:hi, None], first, axis=0)
        return out


def _roots(g: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(t, b) for a block x with x'x = g: x t is orthonormal and x = (x t) b, without directions shorter than NOTHING of sqrt(most)."""
    e, u = np.linalg.eigh((g + g.T) / 2)
    some = e > NOTHING**2 * most
    root = np.sqrt(e[some])
    return u[:, some] / root, root[:, None] * u[:, some].T


def left_vectors(weights: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """id (bigint), vector: rows (id, term, weight) times the first k right singular vectors of all of them, which are the left ones times the singular values; nothing is centred, fewer than k where there are no more.

    Block Lanczos on the rows' products with full reorthogonalization, restarted
    with the best vectors when the basis is full, until residuals are below
    TOLERANCE.  Matrix and basis are in the shared folder in parts, a pass reads
    them task by task, and the driver holds the basis's own products only.
    """
    spark = weights.sparkSession
    path = scratch(spark, "numbered")
    ranked(weights.join(terms, "term", "left_semi").select("id").distinct(), ["id"], "at").write.parquet(path)
    numbers = spark.read.parquet(path)
    n, width = numbers.count(), terms.count()
    if not n:
        return spark.createDataFrame([], "id bigint, vector array<double>")
    a = _Sparse(weights.join(terms, "term").join(numbers, "id").select("at", "index", "weight"), n, width)
    shelf, high, rows, columns = a.shelf, a.high, a.rows, a.columns
    k = min(k, n, width)
    block = min(n, width, max(8, k // 2 + 5))
    basis: list[tuple[str, int]] = []  # names and widths
    made = iter(range(1 << 30))

    def across(part: int, own: list[tuple[str, int]], x: np.ndarray) -> np.ndarray:
        return np.concatenate([shelf.get(q, part, w).T @ x for q, w in own]) if own else np.zeros((0, x.shape[1]))

    def less(part: int, own: list[tuple[str, int]], x: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = 0
        x = x.copy()
        for q, w in own:
            x -= shelf.get(q, part, w) @ c[at : at + w]
            at += w
        return x

    def turned(name: str, size: int, c: np.ndarray, t: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
        """(name, Q'x, x'x) of x = (block - Q c) t."""
        out, own = f"x{next(made)}", list(basis)

        def run(part: int) -> np.ndarray:
            x = less(part, own, shelf.get(name, part, size), c) @ t
            shelf.put(out, part, x)
            return np.concatenate([across(part, own, x), x.T @ x]).ravel()

        both = sum(a.each(rows, run)).reshape(-1, t.shape[1])
        return out, both[: -t.shape[1]], both[-t.shape[1] :]

    def orthonormal(name: str, size: int, c: np.ndarray, most: float) -> tuple[str, int, np.ndarray]:
        """(name, size, b) of the block less its part in the basis: block - Q c = x b, with x orthonormal and orthogonal to Q."""
        whole, t, name_of = np.eye(size), np.eye(size), name
        for _ in range(6):
            old, size_of = name_of, t.shape[0]
            name_of, c, g = turned(old, size_of, c, t)
            shelf.drop(old)
            own = g - c.T @ c
            if most < 0:
                most = float(np.trace(own))
            if len(own) and np.abs(own - np.eye(len(own))).max() < 1e-12 and np.abs(c).max(initial=0.0) < 1e-12:
                return name_of, len(own), whole
            t, b = _roots(own, most)
            whole, most = b @ whole, 1.0
            if not t.shape[1]:
                break
        if t.shape[1]:
            name_of, _, _ = turned(name_of, t.shape[0], c, t)
        return name_of, t.shape[1], whole

    start = f"x{next(made)}"

    def random(part: int) -> None:
        shelf.put(start, part, np.random.default_rng([2015, part]).standard_normal((min(high, n - part * high), block)))

    a.each(rows, random)
    name, size, _ = orthonormal(start, block, np.zeros((0, block)), -1.0)
    products = np.zeros((0, 0))
    while True:
        basis.append((name, size))
        through, product, own, last = f"x{next(made)}", f"x{next(made)}", list(basis), (name, size)

        def transposed(part: int, through=through, last=last) -> None:
            shelf.put(through, part, a.times("columns", part, *last))

        def multiplied(part: int, through=through, product=product, own=own, last=last) -> np.ndarray:
            x = a.times("rows", part, through, last[1])
            shelf.put(product, part, x)
            return across(part, own, x).ravel()

        a.each(columns, transposed)
        c = sum(a.each(rows, multiplied)).reshape(-1, size)
        shelf.drop(through)
        held = len(c) - size
        products = np.block([[products, c[:held]], [c[:held].T, (c[held:] + c[held:].T) / 2]])
        e, y = np.linalg.eigh(products)
        e, y = e[::-1], y[:, ::-1]
        most = max(float(e[0]), np.finfo(float).tiny)
        name, size, b = orthonormal(product, size, c, most**2)
        if not size or len(products) >= k and (np.linalg.norm(b @ y[held:, :k], axis=0) <= np.maximum(TOLERANCE * e[:k], LEAST * most)).all():
            break
        if len(products) + size > max(BASIS * k, 4 * block) and len(products) >= 2 * (k + block):  # full: go on with the best
            kept, own = k + block, list(basis)
            best = f"x{next(made)}"

            def renewed(part: int, best=best, own=own, y=y[:, :kept]) -> None:
                shelf.put(best, part, -less(part, own, np.zeros((min(high, n - part * high), y.shape[1])), y))

            a.each(rows, renewed)
            for q, _ in basis:
                shelf.drop(q)
            basis, products = [(best, kept)], np.diag(e[:kept])

    some = np.flatnonzero(e[:k] > NOTHING**2 * most)
    scaled, own = y[:, some] * np.sqrt(e[some]), list(basis)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in batches:
            at = batch.column(1).to_numpy()
            out = np.empty((len(at), scaled.shape[1]))
            for p in np.unique(at // high).tolist():
                if p != part:
                    part, held = p, -less(p, own, np.zeros((min(high, n - p * high), scaled.shape[1])), scaled)
                mine = at // high == p
                out[mine] = held[at[mine] % high]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["id", "vector"])

    placed = numbers.select(F.col("id").cast("bigint").alias("id"), F.col("at").cast("bigint").alias("at"))
    return placed.repartitionByRange(rows, "at").sortWithinPartitions("at").mapInArrow(vectors, "id bigint, vector array<double>")
