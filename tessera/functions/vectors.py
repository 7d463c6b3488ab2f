"""Vector arithmetic, and exact top-k of a query set against all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.session import BROADCAST_ROWS, written

#: Query vectors searched in one pass over the rows; more are searched in further passes.
BLOCK = 4_096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for null and zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the usable vectors of one length."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    rows = np.nonzero(sizes == length)[0]
    if not len(rows):
        return rows, np.zeros((0, length))
    m = np.asarray(column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(rows), length)
    norm = np.sqrt((m * m).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], m[good] / norm[good, None]


def _search(names: list, vectors: np.ndarray, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=object)) for _ in names]
        for batch in batches:
            rows, m = _matrix(batch.column(1), vectors.shape[1])
            if not len(rows):
                continue
            ids = np.asarray(batch.column(0).take(pa.array(rows)).to_pylist(), dtype=object)
            order = np.argsort(ids.astype(str), kind="stable")
            ids, m = ids[order], m[order]
            for at in range(0, len(names), 256):
                sims = np.round(vectors[at : at + 256] @ m.T, 9)
                if sims.shape[1] > k:
                    edge = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
                for i, row in enumerate(sims):
                    pick = np.nonzero(row >= edge[i])[0] if sims.shape[1] > k else np.arange(len(row))
                    s, d = np.concatenate([best[at + i][0], row[pick]]), np.concatenate([best[at + i][1], ids[pick]])
                    top = np.lexsort((d.astype(str), -s))[:k]
                    best[at + i] = (s[top], d[top])
        for name, (s, d) in zip(names, best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(s), pa.int64()), pa.array(d.tolist(), pa.string()), pa.array(s)], names=["query_id", "id", "similarity"])

    return run


def _all(names: list, vectors: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m = _matrix(batch.column(1), vectors.shape[1])
            ids = batch.column(0).take(pa.array(rows))
            for at in range(0, len(names), 64):
                sims = np.round(vectors[at : at + 64] @ m.T, 9)
                for name, row in zip(names[at : at + 64], sims):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), name), pa.int64()), ids, pa.array(row)], names=["query_id", "id", "similarity"])

    return run


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, unit vectors) of the usable queries, by length, in blocks of about ``BLOCK``."""
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "vec").filter("vec is not null and size(vec) > 0")
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    for b in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()  # about BLOCK rows
        for length in sorted({len(r.vec) for r in some}):
            own = [r for r in some if len(r.vec) == length]
            v = np.array([[np.nan if x is None else x for x in r.vec] for r in own], dtype=np.float64)
            with np.errstate(invalid="ignore"):
                norm = np.sqrt((v * v).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            if good.any():
                yield [r.query_id for r, g in zip(own, good) if g], v[good] / norm[good, None]


def alike(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, members): each different vector of ``queries`` (query_id, vec) once as (query_id, vec) under a number of its own, and
    (head, query_id) of the questions that have it. A search asks for each head once."""
    usable = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null and size(vec) > 0")
    heads = written(usable.select("vec").distinct().withColumn("head", F.monotonically_increasing_id()), "heads")
    members = written(usable.join(heads, "vec").select("head", "query_id").distinct(), "members")
    return heads.select(F.col("head").alias("query_id"), "vec"), members


def of_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """What was found for the heads (query_id) of :func:`alike`, for each question."""
    few = members.count() <= BROADCAST_ROWS
    return found.withColumnRenamed("query_id", "head").join(F.broadcast(members) if few else members, "head").select("query_id", *(c for c in found.columns if c != "query_id"))


def similarities(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``(query_id, id, similarity)`` of every query and every row, for a query set that is small; as :func:`nearest_rows` else."""
    usable = rows.select(F.col("id").cast("string").alias("id"), "vec").filter("vec is not null and id is not null")
    out = queries.sparkSession.createDataFrame([], "query_id long, id string, similarity double")
    for names, vectors in _query_blocks(queries):
        out = out.unionByName(usable.mapInArrow(_all(names, vectors), "query_id long, id string, similarity double"))
    return out


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, similarity, rank)``: the ``k`` rows most similar to each query, exactly.

    ``queries`` (query_id long, vec), ``rows`` (id string, vec). Each task keeps only its ``k`` best per
    query, so at most ``k`` rows a query and task are shuffled. Query vectors reach the tasks in blocks of
    bounded size, and questions of the same vector are searched once. Null, zero and non-finite vectors match
    nothing; vectors of different lengths do not meet; ties go to the smaller id.
    """
    spark = queries.sparkSession
    queries, members = alike(queries)
    found = rows.select(F.col("id").cast("string").alias("id"), "vec").filter("vec is not null and id is not null")
    parts = [found.mapInArrow(_search(names, vectors, k), "query_id long, id string, similarity double") for names, vectors in _query_blocks(queries)]
    if not parts:
        return spark.createDataFrame([], "query_id long, id string, similarity double, rank int")
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return of_members(merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), members)


class VectorIndex:
    """An approximate index: rows lie in the folder of their nearest centroid, and a query reads only the nearest folders.

    Centroids are fitted on a bounded sample of ``sample`` rows; every row is indexed. With ``probes`` cells
    a query, the recall against the exact search grows with ``probes / cells``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, seed: int = 5) -> "VectorIndex":
        """Write the index of ``rows`` (id, vec); unusable vectors are left out."""
        usable = rows.select(F.col("id").cast("string").alias("id"), "vec").filter("vec is not null and id is not null and size(vec) > 0")
        picked = usable.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()  # bounded by the parameter
        by_length: dict[int, list] = {}
        for r in picked:
            by_length.setdefault(len(r.vec), []).append(r.vec)
        rng = np.random.default_rng(seed)
        centroids: dict[int, np.ndarray] = {}
        for length, vecs in by_length.items():
            m = np.array([[np.nan if x is None else x for x in v] for v in vecs], dtype=np.float64)
            norm = np.sqrt((m * m).sum(1))
            m = m[np.isfinite(norm) & (norm > 0)]
            if not len(m):
                continue
            m = m / np.sqrt((m * m).sum(1))[:, None]
            centre = m[rng.permutation(len(m))[:cells]]
            for _ in range(rounds):
                own = (m @ centre.T).argmax(1)
                for c in range(len(centre)):
                    mine = m[own == c]
                    if len(mine):
                        mean = mine.mean(0)
                        centre[c] = mean / (np.sqrt((mean * mean).sum()) or 1.0)
            centroids[length] = centre
        table = [(int(length), c, v.tolist()) for length, m in centroids.items() for c, v in enumerate(m)]
        self.spark.createDataFrame(table, "dim int, cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.asarray(batch.column(1).value_lengths().fill_null(0))
                for length in np.unique(sizes[sizes > 0]):
                    rows_, m = _matrix(batch.column(1), int(length))
                    centre = centroids.get(int(length))
                    cell = (m @ centre.T).argmax(1) if centre is not None else np.zeros(len(rows_), dtype=np.int64)
                    unit = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, int(length)), pa.int32()), pa.array(m.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_)), unit, pa.array(np.full(len(rows_), length), pa.int32()), pa.array(cell.astype(np.int32))], names=["id", "vec", "dim", "cell"])

        placed = usable.mapInArrow(assign, "id string, vec array<double>, dim int, cell int")
        placed.repartition("dim", "cell").write.partitionBy("dim", "cell").parquet(f"{self.path}/rows")
        return self

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """``(query_id, id, similarity, rank)`` as :func:`nearest_rows`, among the rows of each query's ``probes`` nearest cells."""
        centres = self.spark.read.parquet(f"{self.path}/centres").collect()  # bounded by the cells
        rows = self.spark.read.schema("id string, vec array<double>, dim int, cell int").parquet(f"{self.path}/rows")
        out = self.spark.createDataFrame([], "query_id long, id string, similarity double")
        for names, vectors in _query_blocks(queries):
            own = [c for c in centres if c.dim == vectors.shape[1]]
            if not own:
                continue
            best = np.argsort(-(vectors @ np.array([c.centre for c in own]).T), axis=1)[:, :probes]
            asks = [(own[c].cell, name, v.tolist()) for name, v, cells in zip(names, vectors, best) for c in cells]
            wanted = sorted({a[0] for a in asks})
            there = rows.filter((F.col("dim") == vectors.shape[1]) & F.col("cell").isin(wanted))  # only these folders are read
            by_cell: dict[int, tuple[list, list]] = {}
            for cell, name, v in asks:
                by_cell.setdefault(cell, ([], []))[0].append(name)
                by_cell[cell][1].append(v)
            packed = {cell: (n, np.array(v)) for cell, (n, v) in by_cell.items()}

            def look(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    cells = np.asarray(batch.column(2))
                    for cell in np.unique(cells):
                        part = batch.filter(pa.array(cells == cell))
                        yield from _search(*packed[int(cell)], k)(iter([pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["id", "vec"])]))

            out = out.unionByName(there.select("id", "vec", "cell").mapInArrow(look, "query_id long, id string, similarity double"))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
