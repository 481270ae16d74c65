"""Nearest neighbours by a block matrix join (largest inner product).

Vectors are dealt into stripes of bounded size and the stripes are joined as a grid: queries are repeated for every
stripe of candidates and candidates for every stripe of queries, so a task holds one block of each. Within a tile both
sides are quantised to int8 with a scale for each vector; the integer product (exact in float32 up to 1,040 dimensions,
in float64 beyond) with its quantisation error bound gives an upper and a lower bound for every pair. Pairs whose upper
bound reaches the query's k-th best are recomputed in double precision on the original vectors and merged by a heap for
each query; the tiles' lists are merged by rank. The bounds are proven, so the search is exact (recall 1).

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, and neither do null ids;
vectors are compared with those of the same length only; of rows that repeat an id the least vector counts; equal
scores go to the smaller id; fewer candidates than k give all of them; an empty table gives no rows. Other columns are
not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Rows of a stripe, as aimed for: a tile holds one stripe of either side.
QUERY_STRIPE, BASE_STRIPE = 4096, 16_384
#: Rows of a product block within a tile.
QUERY_BLOCK, BASE_BLOCK = 512, 2048


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 components, scale of each vector, sum of absolute components)."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(float).tiny
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    return q, scale, np.abs(q.astype(np.int32)).sum(axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components, so that equal vectors have equal scores."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def best(query_ids: np.ndarray, queries: np.ndarray, base_ids: np.ndarray, base: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of the k best candidates of each query in this tile."""
    d = base.shape[1]
    wide = np.float32 if d * 127 * 127 < 1 << 24 else np.float64
    qb, sb, lb = quantise(base)
    out = []
    for i in range(0, len(queries), QUERY_BLOCK):
        x, ids = queries[i : i + QUERY_BLOCK], query_ids[i : i + QUERY_BLOCK]
        qx, sx, lx = quantise(x)
        heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        floor = np.full(len(ids), -np.inf)
        for j in range(0, len(base), BASE_BLOCK):
            s = slice(j, j + BASE_BLOCK)
            unit = sx[:, None] * sb[s][None, :]
            about = (qx.astype(wide) @ qb[s].astype(wide).T).astype(np.float64)
            off = (lx[:, None] + lb[s][None, :]) / 2 + d / 4 + 1e-6 * d  # the last term covers rounding
            own = ids[:, None] == base_ids[s][None, :]
            low = np.where(own, -np.inf, unit * (about - off))
            if low.shape[1] > k:
                floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            rows, cols = np.nonzero((unit * (about + off) >= floor[:, None]) & ~own)
            exact = inner(x[rows], base[s][cols])
            for r, c, score in zip(rows.tolist(), base_ids[s][cols].tolist(), exact.tolist()):
                heap, item = heaps[r], (score, -c)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            full = [r for r in np.unique(rows).tolist() if len(heaps[r]) == k]
            if full:
                floor[full] = np.maximum(floor[full], [heaps[r][0][0] for r in full])
        out += [(int(q), -c, score) for q, heap in zip(ids.tolist(), heaps) for score, c in heap]
    return out


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array of double), dim of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(finite & F.exists("v", lambda x: x != 0))
    return clean.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of every query; is_query tests vec_id."""
    base, _ = written(usable(vectors, vec_id, vector), "vectors")
    queries = base.filter(is_query)
    n, m = base.count(), queries.count()
    stripes, rows = max(1, -(-n // BASE_STRIPE)), max(1, -(-m // QUERY_STRIPE))
    deal = lambda many: F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = queries.select("dim", deal(rows).alias("i"), each(stripes).alias("j"), "vec_id", "v")
    right = base.select("dim", each(rows).alias("i"), deal(stripes).alias("j"), "vec_id", "v")

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids, flat = t.column("vec_id").to_numpy(), t.column("v").combine_chunks()
            order = np.argsort(ids, kind="stable")
            return ids[order], flat.flatten().to_numpy().reshape(len(ids), -1)[order]

        found = best(*side(a), *side(b), k) if a.num_rows and b.num_rows else []
        cols = list(zip(*found)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    tiles = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(tile, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_digest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0, 20)


#: Every pair of a query and a candidate by its inner product in double precision, the 20 best of each query.
NEAREST_SQL = """
WITH u AS (SELECT vec_id::BIGINT AS vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(q.v, b.v) AS score
      FROM u q JOIN u b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id AND len(q.v) = len(b.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
