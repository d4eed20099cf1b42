"""Exact nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt into cells of bounded size; each cell of the grid multiplies the int8
forms of its two sides. With x = scale * int8 + rest, the distance of two int8 forms differs from that of
the vectors by at most the sum of the lengths of the two rests. A pair whose lower bound is over the
query's k-th smallest upper bound so far goes; survivors are recomputed in double precision and kept in a
heap for each query; the heaps of a query's cells are merged by heaps.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_CELL = 4096
CANDIDATE_CELL = 32768
TILE = 2048


def takes_part(vector: str = "embedding") -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.exists(v, lambda x: x != 0)


def quantise(x):
    """int8 values (as float32, so that a product of tiles is exact), scales, and lengths of the rests (a little more)."""
    import numpy as np

    scale = np.abs(x).max(1) / 127.0
    scale[scale == 0] = 1.0  # only if the quotient underflows
    q = np.rint(x / scale[:, None])
    rest = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))
    return q.astype(np.float32 if x.shape[1] <= 1000 else np.float64), scale, rest * (1 + 1e-9) + 1e-300


def exact(a, b):
    """Row by row Euclidean distance in double precision, summed in the order of the components."""
    import numpy as np

    d = np.zeros(len(a))
    for j in range(a.shape[1]):
        t = a[:, j] - b[:, j]
        d += t * t
    return np.sqrt(d)


def cell_search(queries, query_ids, candidates, candidate_ids, k: int):
    """For each query its k nearest of one cell: lists of (distance, id), ascending, ties to the smaller id."""
    import numpy as np

    best = [[] for _ in query_ids]
    worst = np.full(len(query_ids), np.inf)
    if not len(candidates) or not len(queries):
        return best
    big = max(np.abs(queries).max(), np.abs(candidates).max())
    if not 1e-100 < big < 1e100:  # keeps squares finite; dividing by a power of two loses nothing here
        unit = 2.0 ** np.floor(np.log2(big))
    else:
        unit = 1.0
    qx, sx, ex = quantise(queries / unit)
    nx = (qx.astype(np.float64) ** 2).sum(1) * sx**2
    for lo in range(0, len(candidates), TILE):
        y, yid = candidates[lo : lo + TILE], candidate_ids[lo : lo + TILE]
        qy, sy, ey = quantise(y / unit)
        ny = (qy.astype(np.float64) ** 2).sum(1) * sy**2
        square = nx[:, None] + ny[None, :] - 2 * (sx[:, None] * sy[None, :]) * (qx @ qy.T)
        slack = 1e-12 * (nx[:, None] + ny[None, :])
        low = np.sqrt(np.maximum(square - slack, 0)) - (ex[:, None] + ey[None, :])
        high = np.sqrt(np.maximum(square + slack, 0)) + (ex[:, None] + ey[None, :])
        own = query_ids[:, None] == yid[None, :]
        low[own] = high[own] = np.inf
        limit = worst / unit * (1 + 1e-12)
        if high.shape[1] >= k:
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((low <= limit[:, None]) & np.isfinite(low))
        for a in range(0, len(i), 1 << 16):
            rows, cols = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            d = exact(queries[rows], y[cols])
            order = np.lexsort((yid[cols], d, rows))
            rows, cols, d = rows[order], cols[order], d[order]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            for s, e in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
                e = min(e, s + k)  # the tile's k nearest of this query; no later one can count
                q = int(rows[s])
                best[q] = sorted([*best[q], *zip(d[s:e].tolist(), yid[cols[s:e]].tolist(), strict=True)])[:k]
                if len(best[q]) == k:
                    worst[q] = best[q][-1][0]
    return best


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query row by Euclidean distance, all rows being candidates.

    Rows whose vector is null, empty, zero or holds null or non-finite components, and rows without an id, take
    no part. A row with the query's id is never its candidate; a repeated candidate row counts once each time,
    a repeated query id is searched once, with the smallest of its vectors. Only vectors of one length meet.
    """
    spark = vectors.sparkSession
    base = vectors.where(takes_part(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    counts = base.agg(F.count("*").alias("n"), F.count_if("q").alias("m")).first()
    parallel = 2 * spark.sparkContext.defaultParallelism
    wide = max(1, min(-(-counts.n // 512), max(parallel, -(-counts.n // CANDIDATE_CELL))))
    high = max(1, -(-counts.m // QUERY_CELL))
    dealt = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = base.where("q").groupBy("id").agg(F.min("v").alias("v"))
    left = queries.select("id", "v", F.size("v").alias("dim"), dealt(high, 1).alias("x")).select("*", every(wide).alias("y"))
    right = base.select("id", "v", F.size("v").alias("dim"), dealt(wide, 2).alias("y")).select("*", every(high).alias("x"))

    def search(a, b):
        import numpy as np
        import pyarrow as pa

        side = lambda t: (np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1)), t.column("id").to_numpy())
        (x, xid), (y, yid) = side(a), side(b)
        found = cell_search(x, xid, y, yid, k)
        n = [len(f) for f in found]
        flat = [p for f in found for p in f]
        return pa.table({"query_id": pa.array(np.repeat(xid, n), pa.int64()), "vec_id": pa.array([p[1] for p in flat], pa.int64()), "score": pa.array([p[0] for p in flat], pa.float64())})

    near = left.groupBy("dim", "x", "y").cogroup(right.groupBy("dim", "x", "y")).applyInArrow(search, "query_id long, vec_id long, score double")

    def merge(batches: Iterator) -> Iterator:
        import heapq

        import pyarrow as pa

        heaps: dict = {}
        for batch in batches:
            for q, v, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (-s, -v))
                else:
                    heapq.heappushpop(heap, (-s, -v))
        out = [(q, r, -v, -s) for q, heap in heaps.items() for r, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        if out:
            q, r, v, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array([x + 0.0 for x in s], pa.float64())], ["query_id", "rank", "vec_id", "score"])

    return near.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
