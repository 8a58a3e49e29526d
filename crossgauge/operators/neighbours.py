"""Exact nearest neighbours that skip what can't hold one.

A coarse quantiser deals the searched vectors into cells around centroids; a cell is known by its radius, its largest norm
and its size. Every query first looks at the cell of its nearest centroid. By the triangle inequality no vector of another
cell is nearer to it than its distance from that centroid less the radius, which bounds the products with the whole cell;
only cells whose bound reaches the best product found so far are visited. On clustered vectors most are not, on vectors
without structure all are: the result is exact either way. Nothing but the centroids and the cells' figures, a bounded
number, passes through the driver; queries and cells meet in blocks on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgauge.operators.relational import VECTOR_BLOCK
from crossgauge.operators.relational import nearest as all_pairs
from crossgauge.sources.io import scratch

#: Most cells, and sampled vectors for each of them from which the centroids are made.
CELLS, SAMPLED, ROUNDS = 1024, 4, 3
#: Products within this of each other count as possibly equal, so rounding never skips a cell.
SLACK = 1e-9
_VECTOR = "id long, v array<double>"
_FOUND = "id long, other long, sim double"


def _stack(column) -> np.ndarray:
    """The vectors of a non-empty Arrow list column."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Cells:
    """Centroids with the radius, largest squared norm and size of every cell."""

    centroids: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    size: np.ndarray

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.size > 0, _distances(x, self.centroids), np.inf).argmin(1)

    def reach(self, x: np.ndarray) -> np.ndarray:
        """A bound of the products of each row with the vectors of each cell: x.y = (|x|^2 + |y|^2 - |x - y|^2) / 2."""
        near = np.maximum(0, _distances(x, self.centroids) - self.radius - 1e-7)
        bound = ((x * x).sum(1)[:, None] + self.norm[None, :] - near * near) / 2
        return np.where(self.size > 0, bound, -np.inf)


def centroids_of(index: DataFrame, cells: int) -> np.ndarray:
    """Some rounds of k-means on the SAMPLED * cells vectors of least hash; any centroids give exact results."""
    rows = index.orderBy(F.xxhash64("id"), "id").limit(SAMPLED * cells).toArrow()
    x = _stack(rows.column("v"))
    centroids = x[:cells].copy()
    for _ in range(ROUNDS):
        own = _distances(x, centroids).argmin(1)
        for k in np.unique(own):
            centroids[k] = x[own == k].mean(0)
    return centroids


def _dealt(index: DataFrame, centroids: np.ndarray) -> tuple[DataFrame, Cells]:
    """A written table id, v, cell, and the cells."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(centroids)

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = _stack(b.column(1))
                d = _distances(x, shared.value)
                own = d.argmin(1)
                yield pa.record_batch([*b.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(x)), own]), pa.array((x * x).sum(1))], names=["id", "v", "cell", "d", "norm"])

    path = scratch(spark, "cells")
    index.mapInArrow(deal, f"{_VECTOR}, cell int, d double, norm double").write.parquet(path)
    placed = spark.read.parquet(path)
    radius, norm, size = np.zeros(len(centroids)), np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("cell").agg(F.max("d").alias("d"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect():  # at most CELLS rows
        radius[r["cell"]], norm[r["cell"]], size[r["cell"]] = r["d"], r["norm"], r["n"]
    return placed.select("id", "v", "cell"), Cells(centroids, radius, norm, size)


def _best(queries, vectors):
    """Each query's best vector of a block; ties go to the smaller id."""
    import pyarrow as pa

    empty = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
    if not queries.num_rows or not vectors.num_rows:
        return empty
    others = vectors.column("id").to_numpy()
    order = np.argsort(others, kind="stable")
    others, y = others[order], _stack(vectors.column("v"))[order]
    x, out, sims = _stack(queries.column("v")), [], []
    for i in range(0, len(x), 1024):
        sim = x[i : i + 1024] @ y.T
        top = sim.argmax(1)
        out.append(others[top])
        sims.append(sim[np.arange(len(sim)), top])
    return pa.table({"id": queries.column("id"), "other": np.concatenate(out), "sim": np.concatenate(sims)})


def _visit(probes: DataFrame, queries: DataFrame, placed: DataFrame, cells: Cells, block: int) -> DataFrame:
    """id, other, sim of every probe (id, cell) for each block of the cell; a cell's vectors and its queries are cut into blocks."""
    spark = probes.sparkSession
    asked = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
    if not asked:
        return spark.createDataFrame([], _FOUND)
    shape = [(k, -(-n // block), max(1, -(-int(cells.size[k]) // block))) for k, n in asked.items()]
    sizes = F.broadcast(spark.createDataFrame(shape, "cell int, n_q int, n_v int"))
    q = probes.join(sizes, "cell").withColumn("_q", F.pmod(F.xxhash64("id"), "n_q").cast("int")).withColumn("_v", F.explode(F.sequence(F.lit(0), F.col("n_v") - 1)))
    q = q.join(queries, "id").select("cell", "_q", "_v", "id", "v")
    v = placed.join(sizes, "cell").withColumn("_v", F.pmod(F.xxhash64("id"), "n_v").cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))
    v = v.select("cell", "_q", "_v", "id", "v")
    return q.groupBy("cell", "_q", "_v").cogroup(v.groupBy("cell", "_q", "_v")).applyInArrow(lambda a, b: _best(a, b), _FOUND)


def _top(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min_by("other", F.struct(-F.col("sim"), F.col("other"))).alias("other"), F.max("sim").alias("sim"))


def search(queries: DataFrame, index: DataFrame, cells: int | None = None, block: int = VECTOR_BLOCK) -> tuple[DataFrame, DataFrame, Cells]:
    """(id, other, sim of every query's nearest vector of the index; the probes id, cell that took; the cells).

    Frames have (id, v), v of one length and ids unlike; null vectors are left out; ties go to the smaller id; an empty
    index gives no row. cells: by default the root of the index's size, CELLS at most.
    """
    spark = queries.sparkSession
    queries, index = (x.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL") for x in (queries, index))
    n = index.count()
    if not n:
        return spark.createDataFrame([], _FOUND), spark.createDataFrame([], "id long, cell int"), Cells(np.zeros((0, 0)), *(np.zeros(0) for _ in range(3)))
    placed, known = _dealt(index, centroids_of(index, cells or min(CELLS, max(1, int(n**0.5)))))
    shared = spark.sparkContext.broadcast(known)

    def homes(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), pa.array(shared.value.home(_stack(b.column(1))).astype(np.int32))], names=["id", "cell"])

    def others(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = _stack(b.column(1))
                reach = shared.value.reach(x)
                reach[np.arange(len(x)), b.column(2).to_numpy()] = -np.inf  # seen
                row, cell = np.nonzero(reach >= b.column(3).to_numpy()[:, None] - SLACK)
                yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32))], names=["id", "cell"])

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    probe = "id long, cell int"
    home = written(queries.mapInArrow(homes, probe), "home")
    first = written(_top(_visit(home, queries, placed, known, block)), "first")
    rest = queries.join(home, "id").join(first, "id").select("id", "v", "cell", "sim")
    more = written(rest.mapInArrow(others, probe), "more")
    return _top(first.union(_visit(more, queries, placed, known, block))), home.union(more), known


def nearest(left: DataFrame, right: DataFrame, sides: str = "lr", block: int = VECTOR_BLOCK) -> DataFrame:
    """side, id, other, sim as relational.nearest gives them; inputs of one block a side are one product, larger ones go by cells."""
    n_left, n_right = left.count(), right.count()
    if n_left <= block and n_right <= block:
        return all_pairs(left, right, block).where(F.col("side").isin(*sides))
    found = [search(a, b, block=block)[0].select(F.lit(s).alias("side"), "id", "other", "sim") for s, a, b in (("l", left, right), ("r", right, left)) if s in sides]
    return found[0] if len(found) == 1 else found[0].union(found[1])


def mutual_nearest(left: DataFrame, right: DataFrame, tau: float, block: int = VECTOR_BLOCK) -> DataFrame:
    """Pairs (l, r, sim) that are each other's nearest, at or above tau."""
    best = nearest(left, right, block=block).where(F.col("sim") >= tau)
    a, b = best.where("side = 'l'"), best.where("side = 'r'")
    return a.select(F.col("id").alias("l"), F.col("other").alias("r"), "sim").join(b.select(F.col("other").alias("l"), F.col("id").alias("r")), ["l", "r"])
