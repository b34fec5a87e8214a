"""Exact k nearest neighbours as a partitioned join.

Reference vectors are assigned to the nearest of a few pivots and cut into chunks of
bounded size. A query first searches the chunks of its own pivot, which bounds its
k-th distance, and then only the chunks that the triangle inequality cannot rule
out. A task meets one chunk and one bounded slice of its queries; it returns the best
k per query, never the pairs. Nothing is dropped, so the result is exact.

Every path ranks by one key, the distance taken from the difference of two vectors, then
the id. Matrix products only choose candidates, with a margin for their rounding. Vectors
with a component that is not finite have no neighbours and are nobody's neighbour.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.draws import hash_long
from evalspark.functions.vectors import matrix
from evalspark.scaling import MODEL_BYTES, setting, stable

# Reference rows per chunk and query rows per task, at least; and bytes of vectors that a task holds of either side.
CHUNK_ROWS = 4096
QUERY_ROWS = 8192
SIDE_BYTES = 32 * 1024 * 1024
# A query travels once for each chunk it visits, so chunks grow with the reference rows instead of becoming more.
CHUNKS = 16
MAX_PIVOTS = 4096
# Tiles of a distance matrix, and pairs whose differences are taken at a time.
TILE_QUERIES, TILE_POINTS, TILE_PAIRS = 256, 8192, 16_384


@dataclass(frozen=True)
class Cells:
    """Pivots and, per pivot, how many reference rows it holds and how far they reach."""

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    chunks: np.ndarray

    @property
    def first_chunk(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.chunks)[:-1]])


def rounding(width: int) -> float:
    """Bound of the error of |a|2 + |b|2 - 2ab, as a share of |a|2 + |b|2."""
    return 4 * (width + 4) * np.finfo(float).eps


def products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances by matrix product, a bound of their error for each row of ``a``)."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    return aa[:, None] + bb[None, :] - 2.0 * (a @ b.T), rounding(a.shape[1]) * (aa + bb.max(initial=0.0))


def _gaps(q: np.ndarray, r: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of the pairs, from the differences."""
    out = np.empty(len(rows))
    for k in range(0, len(rows), TILE_PAIRS):
        part = slice(k, k + TILE_PAIRS)
        out[part] = np.sqrt(((q[rows[part]] - r[cols[part]]) ** 2).sum(1))
    return out


def nearest_rows(
    q: np.ndarray, r: np.ndarray, k: int, qids: np.ndarray | None = None, rids: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``r``, distance) of the k nearest, by distance and then by row of ``r``.

    Pairs with equal ids are left out where ids are given. Both sides are cut into tiles, so memory does not grow
    with either.
    """
    asked, known = (np.flatnonzero(np.isfinite(x).all(1)) for x in (q, r))
    found = []
    # Without its common offset a tile loses little to cancellation.
    centre = r[known].mean(0) if len(known) else 0.0
    for i in range(0, len(asked), TILE_QUERIES):
        rows = asked[i : i + TILE_QUERIES]
        x = q[rows] - centre
        limit = np.full(len(rows), np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for j in range(0, len(known), TILE_POINTS):
            cols = known[j : j + TILE_POINTS]
            d2, wide = products(x, r[cols] - centre)
            if qids is not None:
                d2[qids[rows][:, None] == rids[cols][None, :]] = np.inf
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if k < len(cols) else np.inf
            reach = np.minimum(kth, limit * limit) + 2 * wide
            a, b = np.nonzero((d2 <= reach[:, None]) & np.isfinite(d2))
            near = (a, cols[b], _gaps(q, r, rows[a], cols[b]))
            row, col, dist = (np.concatenate(pair) for pair in zip(best, near, strict=True))
            order = np.lexsort((col, dist, row))
            row, col, dist = row[order], col[order], dist[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = tuple(part[rank < k] for part in (row, col, dist))
            last = rank == k - 1
            limit[row[last]] = dist[last]
        found.append((rows[best[0]], best[1], best[2]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _nearest_pivot(pivots: np.ndarray):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<cell:int,dist:double>")
    def assign(vectors: pa.Array) -> pa.Array:
        cell, dist = np.full(len(vectors), -1, np.int32), np.full(len(vectors), np.nan)
        if len(vectors):
            rows, cols, gaps = nearest_rows(matrix(vectors), pivots, 1)
            cell[rows], dist[rows] = cols, gaps
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(dist)], ["cell", "dist"])

    return assign


def _other_chunks(cells: Cells):
    """Chunks outside the query's own cell that may hold a vector within ``bound``."""
    from pyspark.sql.functions import arrow_udf

    first, counts = cells.first_chunk, cells.chunks
    centre = cells.pivots.mean(0)
    pivots = cells.pivots - centre
    between, wide = products(pivots, pivots)
    # Bounds lean to the side that keeps a chunk.
    gaps = np.sqrt(np.maximum(between, 0) + wide[:, None])

    @arrow_udf("array<int>")
    def pick(vectors: pa.Array, own: pa.Array, bound: pa.Array) -> pa.Array:
        x = matrix(vectors)
        home = own.to_numpy(zero_copy_only=False).astype(np.int64)
        limit = bound.to_numpy(zero_copy_only=False).astype(np.float64)
        limit = np.where(np.isnan(limit), np.inf, limit)
        sizes, chunks = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(x), TILE_QUERIES):
            part = slice(start, min(start + TILE_QUERIES, len(x)))
            rows = np.arange(part.stop - start)
            d2, wide = products(x[part] - centre, pivots)
            d2 = np.maximum(d2 - wide[:, None], 0)
            mine = ((x[part] - cells.pivots[home[part]]) ** 2).sum(1)
            near = np.sqrt(d2) - cells.radius[None, :]
            plane = (d2 - (mine + wide)[:, None]) / (2 * np.maximum(gaps[home[part]], 1e-300))
            slack = 1e-9 * (limit[part][:, None] + cells.radius[None, :])
            keep = (np.maximum(near, plane) <= limit[part][:, None] + slack) & (counts > 0)[None, :]
            keep[rows, home[part]] = False
            row, cell = np.nonzero(keep)
            n = counts[cell]
            sizes.append(np.bincount(row, n, len(rows)).astype(np.int64))
            chunks.append(np.arange(n.sum()) + np.repeat(first[cell] - np.cumsum(n) + n, n))
        offsets = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(chunks).astype(np.int32)))

    return pick


def _task_rows(least: int, n: int, width: int) -> int:
    """Rows of one side in a task: a share of all n, so that the rows sent grow with n, within the bytes of a side."""
    return max(least, min(-(-n // CHUNKS), SIDE_BYTES // (8 * width)))


def _search(queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool, slice_rows: int) -> DataFrame:
    """Best k per (query, chunk). ``queries``: (qid, qvec, chunk); ``refs``: (rid, rvec, chunk)."""
    qtype, rtype = queries.schema["qid"].dataType, refs.schema["rid"].dataType
    load = queries.groupBy("chunk").agg(F.count(F.lit(1)).alias("_q"))
    load = load.withColumn("_slices", F.ceil(F.col("_q") / slice_rows).cast("int")).drop("_q")
    left = queries.join(load, "chunk").withColumn("slice", F.pmod(hash_long("slice", F.col("qid")), F.col("_slices")).cast("int"))
    right = refs.join(load, "chunk").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))

    def best(asked: pa.Table, known: pa.Table) -> pa.Table:
        empty = pa.table({"qid": asked["qid"].slice(0, 0), "rid": known["rid"].slice(0, 0), "dist": pa.array([], pa.float64())})
        if not asked.num_rows or not known.num_rows:
            return empty
        known = known.sort_by("rid")
        q, r = matrix(asked["qvec"]), matrix(known["rvec"])
        qids, rids = (t.to_numpy(zero_copy_only=False) for t in (asked["qid"], known["rid"])) if exclude_self else (None, None)
        rows, cols, exact = nearest_rows(q, r, k, qids, rids)
        return pa.table(
            {"qid": asked["qid"].combine_chunks().take(pa.array(rows)),
             "rid": known["rid"].combine_chunks().take(pa.array(cols)),
             "dist": pa.array(exact)}
        )

    schema = f"qid {qtype.simpleString()}, rid {rtype.simpleString()}, dist double"
    pairs = left.select("qid", "qvec", "chunk", "slice").groupBy("chunk", "slice").cogroup(
        right.select("rid", "rvec", "chunk", "slice").groupBy("chunk", "slice")
    )
    return pairs.applyInArrow(best, schema)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Best k per query over the chunks it visited."""
    nearest = Window.partitionBy("qid").orderBy("dist", "rid")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _plan_cells(refs: DataFrame, n: int, chunk_rows: int, width: int) -> tuple[Cells, DataFrame]:
    most = max(2, min(MAX_PIVOTS, MODEL_BYTES // (8 * width)))
    wanted = min(most, max(2, math.ceil(n / chunk_rows)))
    chosen = refs.orderBy(hash_long("pivot", F.col("rid")), "rid").limit(wanted).select("rvec")
    pivots = matrix(chosen.toArrow()["rvec"])
    placed = refs.withColumn("_a", _nearest_pivot(pivots)(F.col("rvec")))
    placed = stable(placed.select("rid", "rvec", "_a.cell", "_a.dist").where("cell >= 0"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()
    rows, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    for row in stats:
        rows[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    chunks = np.ceil(rows / chunk_rows).astype(np.int64)
    cells = Cells(pivots, rows, radius, chunks)
    first = F.array(*[F.lit(int(c)) for c in cells.first_chunk])
    count = F.array(*[F.lit(int(max(c, 1))) for c in chunks])
    spread = F.pmod(hash_long("chunk", F.col("rid")), F.get(count, F.col("cell"))).cast("int")
    return cells, placed.select("rid", "rvec", (F.get(first, F.col("cell")) + spread).alias("chunk"))


def _finite(col: str) -> Column:
    """Whether all components are finite numbers."""
    return F.forall(col, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))


def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    id_col: str = "id",
    col: str = "embedding",
    exclude_self: bool = False,
    ref_id: str | None = None,
) -> DataFrame:
    """The k nearest reference rows of each query: ``(qid, rank, rid, dist)``, ties by id."""
    spark = queries.sparkSession
    asked = queries.select(F.col(id_col).alias("qid"), F.col(col).alias("qvec"))
    known = refs.select(F.col(ref_id or id_col).alias("rid"), F.col(col).alias("rvec")).where(_finite("rvec"))
    n, width = known.agg(F.count(F.lit(1)), F.max(F.size("rvec"))).first()
    width = max(width or 1, 1)
    chunk_rows, slice_rows = (
        setting(spark, name, _task_rows(least, n, width)) for name, least in (("chunkRows", CHUNK_ROWS), ("queryRows", QUERY_ROWS))
    )
    if n <= chunk_rows:
        one = F.lit(0).alias("chunk")
        found = _search(asked.select("*", one), known.select("*", one), k, exclude_self, slice_rows)
        return _merge(found, k)
    cells, chunked = _plan_cells(known, n, chunk_rows, width)
    homes = asked.withColumn("_a", _nearest_pivot(cells.pivots)(F.col("qvec")))
    homes = stable(homes.select("qid", "qvec", F.col("_a.cell").alias("home")).where("home >= 0"))
    first = F.array(*[F.lit(int(c)) for c in cells.first_chunk])
    last = F.array(*[F.lit(int(c)) for c in cells.first_chunk + cells.chunks - 1])
    begin, end = F.get(first, F.col("home")), F.get(last, F.col("home"))
    own = homes.where(end >= begin).select("qid", "qvec", F.explode(F.sequence(begin, end)).alias("chunk"))
    near = stable(_merge(_search(own, chunked, k, exclude_self, slice_rows), k))
    # Without k neighbours in the own cell there is no bound and every cell is searched.
    bound = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.max("dist")).alias("_bound"))
    wider = homes.join(bound, "qid", "left").withColumn(
        "chunk", F.explode(_other_chunks(cells)(F.col("qvec"), F.col("home"), F.col("_bound")))
    )
    found = _search(wider.select("qid", "qvec", "chunk"), chunked, k, exclude_self, slice_rows)
    return _merge(near.select("qid", "rid", "dist").unionByName(found), k)


def knn_vote(df: DataFrame, k: int = 5, id_col: str = "id", label: str = "label", col: str = "embedding") -> DataFrame:
    """Leave-one-out label by majority of the k nearest other rows; the lowest label wins a tie."""
    near = knn_join(df, df, k, id_col, col, exclude_self=True)
    labels = df.select(F.col(id_col).alias("rid"), F.col(label).alias("_l"))
    votes = near.join(labels, "rid").groupBy("qid", "_l").agg(F.count(F.lit(1)).alias("_n"))
    pick = F.min_by("_l", F.struct((-F.col("_n")).alias("a"), F.col("_l").alias("b")))
    voted = votes.groupBy("qid").agg(pick.alias("y_pred"))
    truth = df.select(F.col(id_col).alias("qid"), F.col(label).alias("y_true"))
    return truth.join(voted, "qid").withColumnRenamed("qid", id_col)
