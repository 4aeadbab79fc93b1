"""Exact top-k search by inner product with a table of pivot distances.

Every vector's distances to the pivots are computed once and written, in blocks
of neighbours: vectors of one length and nearest pivot, in the order of their
distance from it. For a query q, each pivot p bounds the distance of a candidate
x from below by |d(q, p) - d(x, p)|; the largest of these bounds limits the inner
product, (|q|^2 + |x|^2 - d(q, x)^2) / 2, from above. The same holds for a block
with the intervals of its distances and its largest norm.

Each query first searches the block that it lies in; its k-th score there rules
out all blocks whose limit is lower. Queries meet the blocks that are left, some
thousand queries and one block a task's work. Candidates are evaluated in the
order of their limit until it falls under the k-th best score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm.batches import small_batches
from webloom.operators.ordered import range_parts, running_totals
from webloom.runtime import materialize, scratch_path

#: Vectors in a block, and queries that meet it at a time.
BLOCK_ROWS = 8192
#: Rows from which the pivots are chosen: those of the smallest hashed ids.
PIVOT_SAMPLE = 2000
LARGEST = (1 << 63) - 1


def quantize(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(scale * component) of each vector that takes part, whole numbers as doubles."""
    x = F.col(vector_col)
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    unfit = lambda c: c.isNull() | F.isnan(c) | (F.abs(scaled(c)) == float("inf"))
    usable = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, unfit)
    # doubles from 2**53 on are whole numbers
    ints = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < float(1 << 53), F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    return vectors.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def choose_pivots(vectors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By length of vectors: a farthest-first choice of pivots from a sample of PIVOT_SAMPLE rows."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toPandas()["v"].tolist()
    found = {}
    for width in sorted({len(v) for v in sample}):
        rows = np.array([v for v in sample if len(v) == width], dtype=np.float64)
        chosen, nearest = [0], ((rows - rows[0]) ** 2).sum(axis=1)
        while len(chosen) < min(count, len(rows)):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        found[width] = rows[chosen]
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1 if len(column.flatten()) else 0)


def _distances(center: dict[int, np.ndarray], count: int):
    """Add norm, dist (to `count` pivots; where there are fewer, the last one's again), nearest and near to (vec_id, v)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                rows = batch.take(pa.array(np.flatnonzero(widths == width)))
                # lengths that the sample lacks have the origin as their pivot
                pivots = center.get(int(width), np.zeros((1, width)))
                for at in range(0, rows.num_rows, 512):
                    part = rows.slice(at, 512)
                    v = _matrix(part.column(1))
                    far = np.sqrt(((v[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
                    far = np.pad(far, ((0, 0), (0, count - len(pivots))), mode="edge")
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * count), pa.array(far.ravel()))
                    nearest = far.argmin(axis=1)
                    columns = [*part.columns, pa.array(np.full(len(v), width), pa.int32()), pa.array((v**2).sum(axis=1)), lists, pa.array(nearest, pa.int32()), pa.array(far[np.arange(len(v)), nearest])]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "width", "norm", "dist", "nearest", "near"])

    return add


def _under(score: float | int) -> float:
    """A double that is surely not above a score."""
    return float(score) - abs(float(score)) * 1e-12


def best_of_cell(q_ids, q, q_dist, x_ids, x, x_dist, k: int, floors: np.ndarray | None = None) -> tuple[list, list, list, int]:
    """The k best of the candidates x for each query that reach its floor: query ids, ids, scores; and how many products were computed."""
    big = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    exact = float(big) ** 2 * max(1, x.shape[1]) < 1 << 52
    q_norm, x_norm = (q.astype(float) ** 2).sum(axis=1), (x.astype(float) ** 2).sum(axis=1)
    # whole numbers of any size where doubles would round
    if not exact:
        q, x = (np.array([[int(c) for c in row] for row in side], dtype=object).reshape(side.shape) for side in (q, x))
    # distances are rounded: bounds are loosened by far more than that
    slack = 1e-9 * (1 + max(q_dist.max(initial=0), x_dist.max(initial=0)))
    out_q, out_x, out_s, products = [], [], [], 0
    pivots = np.ascontiguousarray(x_dist.T)
    for at in range(0, len(q), 32):
        bound = np.zeros((len(q[at : at + 32]), len(x)))
        gap = np.empty_like(bound)
        for p in range(len(pivots)):
            np.subtract(q_dist[at : at + 32, p, None], pivots[p][None, :], out=gap)
            np.abs(gap, out=gap)
            np.maximum(bound, gap, out=bound)
        limit = (q_norm[at : at + 32, None] + x_norm[None, :] - np.maximum(bound - slack, 0) ** 2) / 2 * (1 + 1e-12) + 1e-3
        limit[np.isnan(limit)] = np.inf
        for i in range(len(limit)):
            high = limit[i]
            high[x_ids == q_ids[at + i]] = -np.inf
            floor = -np.inf if floors is None else floors[at + i]
            alive = np.flatnonzero((high > -np.inf) & (high >= floor))
            ids, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
            step = 64
            while len(alive):
                if len(alive) > step:
                    cut = np.argpartition(-high[alive], step)[:step]
                    now = alive[cut]
                    alive = np.delete(alive, cut)
                else:
                    now, alive = alive, alive[:0]
                ids, scores = np.append(ids, x_ids[now]), np.append(scores, x[now] @ q[at + i])
                products += len(now)
                keep = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[keep], scores[keep]
                if len(ids) == k:
                    floor = max(floor, _under(scores[-1]))
                    alive = alive[high[alive] >= floor]
                step *= 4
            out_q += [int(q_ids[at + i])] * len(ids)
            out_x += ids.tolist()
            out_s += [min(max(int(s), -LARGEST - 1), LARGEST) for s in scores]
    return out_q, out_x, out_s, products


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = 32, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k best other ids.

    The score is the inner product of floor(scale * component), exact at any
    size; beyond the longs it is given as the nearest long. Ties go to the
    smaller id; a query with fewer than k others gets all of them. Vectors of
    different lengths have no product: each meets those of its own length. Null
    vectors and those with a null or non-finite component (or one that scaling
    makes infinite) take no part; nor do rows with a null id. Of rows that share
    an id one takes part, the first in the order of vectors. An empty table
    gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    found = quantize(vectors, scale, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    small_batches(spark)
    found = materialize(found, "vectors")
    center = choose_pivots(found, pivots)
    schema = "vec_id long, v array<double>, width int, norm double, dist array<double>, nearest int, near double"
    order = [F.col(c) for c in ("width", "nearest", "near", "vec_id")]
    parts = range_parts(found.mapInArrow(_distances(center, pivots), schema), order, "pivots")
    nth = running_totals(parts, order, {"nth": F.lit(1).cast("long")}, within=["width"])
    # blocks of one length each
    block = F.struct("width", F.floor((F.col("nth") - 1) / BLOCK_ROWS).alias("n"))
    table = materialize(nth.select("vec_id", "v", "norm", "dist", block.alias("block")), "blocks")
    ends = [f(F.col("dist")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(pivots)]
    blocks = table.groupBy("block").agg(F.max("norm").alias("norm"), *ends)
    blocks = blocks.select("block.*", "norm", *(F.array(*[f"{f}{i}" for i in range(pivots)]).alias(f) for f in ("min", "max")))
    summary = scratch_path(spark, "summary")
    blocks.write.parquet(summary)

    asked = table.filter(F.col("vec_id") % every == 0)
    queries = asked.count()
    query_blocks = max(1, -(-queries // BLOCK_ROWS))
    turn = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [x for t in (left, right) for x in (t.column(2).to_numpy(), _matrix(t.column(3)), _matrix(t.column(4)))]
        q, x, s, _ = best_of_cell(*sides, k, left.column("floor").to_numpy())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(x, pa.int64()), "score": pa.array(s, pa.int64())})

    def search(pairs: DataFrame) -> DataFrame:
        """Queries (block, turn, vec_id, v, dist, floor) against the candidates of their blocks."""
        needed = pairs.select(F.col("block").alias("_block"), "turn").distinct()
        candidates = table.join(needed, F.col("block") == F.col("_block")).select(*(F.col(c).alias(f"x_{c}") for c in ("block", "turn", "vec_id", "v", "dist")))
        return pairs.groupBy("block", "turn").cogroup(candidates.groupBy("x_block", "x_turn")).applyInArrow(cell, "query_id long, vec_id long, score long")

    own = materialize(search(asked.select("block", turn.alias("turn"), "vec_id", "v", "dist", F.lit(float("-inf")).alias("floor"))), "own")
    floors = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
    floor = F.when(F.col("n") == k, F.col("least") - F.abs("least") * 1e-12 - 1).otherwise(F.lit(float("-inf")))
    floors = floors.select("query_id", floor.alias("floor"))
    asked = asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    schema = "vec_id long, v array<double>, dist array<double>, floor double, width int, n long"
    left = asked.select("vec_id", "v", "norm", "dist", "floor", "block.width", "block.n").mapInArrow(_open_blocks(summary), schema)
    pairs = materialize(left.select(F.struct("width", "n").alias("block"), turn.alias("turn"), "vec_id", "v", "dist", "floor"), "open")
    best = own.unionByName(search(pairs))
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _open_blocks(summary: str):
    """For queries (vec_id, v, norm, dist, floor, width, n): a row for each other block whose limit reaches the floor."""

    def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(summary)
        for batch in batches:
            norm, floor, width, own = (batch.column(i).to_numpy() for i in (2, 4, 5, 6))
            dist = _matrix(batch.column(3))
            for blocks in dataset.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=1024):
                if not blocks.num_rows:
                    continue
                least, most = _matrix(blocks.column("min")), _matrix(blocks.column("max"))
                n, kind, largest = (blocks.column(c).to_numpy() for c in ("n", "width", "norm"))
                bound = np.zeros((len(dist), len(n)))
                for p in range(dist.shape[1]):
                    np.maximum(bound, np.maximum(least[:, p] - dist[:, p, None], dist[:, p, None] - most[:, p]), out=bound)
                # as in best_of_cell: looser than any rounding
                slack = 1e-9 * (1 + np.maximum(dist.max(axis=1)[:, None], most.max(axis=1)))
                limit = (norm[:, None] + largest - np.maximum(bound - slack, 0) ** 2) / 2 * (1 + 1e-12) + 1e-3
                keep = (np.isnan(limit) | (limit >= floor[:, None])) & (width[:, None] == kind) & (own[:, None] != n)
                rows, at = np.nonzero(keep)
                if len(rows):
                    taken = batch.take(pa.array(rows))
                    columns = [taken.column(0), taken.column(1), taken.column(3), taken.column(4), pa.array(kind[at]), pa.array(n[at])]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "dist", "floor", "width", "n"])

    return still_open
