"""Exact top-k by inner product, with candidates dismissed by a pivot table.

For a pivot p, | d(q,p) - d(x,p) | <= d(q,x). The table holds every vector's distance to many pivots;
the largest such difference is a lower bound on d(q,x), and as <q,x> = (|q|^2 + |x|^2 - d(q,x)^2) / 2, an
upper bound on the score. Candidates are evaluated from the highest bound down, and a query stops when
its k-th score exceeds every bound left. Nothing is approximate: ties at the bound are evaluated too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import measured, scratch

PIVOTS = 24
#: Queries broadcast at once: at most this many vectors, whatever the input.
QUERY_BLOCK = 2048
#: Candidates evaluated between two looks at the bounds.
STEP = 512


def usable(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x); rows without a vector, or with a null or non-finite component, go."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fit = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(~bad)
    return fit.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * F.lit(scale))).alias("v"))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each dimension that occurs."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    return [(rows := np.flatnonzero(sizes == d), np.stack([flat[ends[r] - d : ends[r]] for r in rows])) for d in np.unique(sizes)]


def _search(q_ids, q, q_table, q_norm, x_ids, x, x_table, x_norm, k, best):
    """Brings best, [(scores, ids)] of each query, up to date with a block of candidates; each row is one."""
    for i in range(len(q_ids)):
        scores, ids = best[i]
        lower = np.abs(x_table - q_table[i]).max(axis=1)
        upper = (q_norm[i] + x_norm - lower * lower) / 2
        upper += 1e-6 * (1 + np.abs(upper))  # distances are rounded
        upper[x_ids == q_ids[i]] = -np.inf
        if len(scores) >= k:
            candidates = np.flatnonzero(upper >= scores[k - 1])
            order = candidates[np.argsort(-upper[candidates], kind="stable")]
        else:
            order = np.argsort(-upper, kind="stable")
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            part = part[upper[part] > -np.inf]
            if not len(part) or len(scores) >= k and upper[part[0]] < scores[k - 1]:
                break
            scores, ids = np.concatenate([scores, x[part] @ q[i]]), np.concatenate([ids, x_ids[part]])
            order_now = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order_now], ids[order_now]
        best[i] = scores, ids


def pivot_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all vectors but those of its own id.

    vectors, queries: (vec_id, v array<long>). Ties go to the smaller vec_id; fewer than k candidates
    give fewer rows. Vectors of another dimension than the query's are no candidates of it. Each row is a
    candidate, so a vec_id that repeats takes a rank each time; of queries equal in id and vector one is asked.
    Sums of squares must stay below 2**53, where doubles are whole; a longer vector is an error.
    """
    spark = vectors.sparkSession
    vectors, seen = measured(vectors, "vectors", longest=F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    if (seen["longest"] or 0) >= 2.0**53:
        raise ValueError("a vector's square is 2**53 or more: divide the vectors")
    # the pivots: a bounded sample, the first by a hash of the id
    chosen = [np.array(r[0], np.float64) for r in vectors.orderBy(F.xxhash64("vec_id"), "v").limit(pivots).select("v").collect()]
    n = queries.count()
    parts = []
    blocks = max(1, -(-n // QUERY_BLOCK))
    numbered = scratch(queries.withColumn("_b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))), "queries")
    for block in range(blocks):
        rows = numbered.where(F.col("_b") == block).select("vec_id", "v").distinct().collect()
        # of equal ids and vectors one is asked; a block is about QUERY_BLOCK rows
        by_size: dict[int, list] = {}
        for vec_id, v in rows:
            by_size.setdefault(len(v), []).append((vec_id, v))
        asked = {}
        for d, some in by_size.items():
            ids, q = np.array([s[0] for s in some], np.int64), np.array([s[1] for s in some], np.float64)
            p = np.array([c for c in chosen if len(c) == d]) if any(len(c) == d for c in chosen) else np.zeros((1, d))
            asked[d] = (ids, q, _distances(q, p), (q * q).sum(1), p)
        parts.append(_ask(spark.sparkContext.broadcast(asked), vectors, k))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T))


def _ask(asked, vectors: DataFrame, k: int) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        best = {d: [(np.zeros(0), np.zeros(0, np.int64))] * len(found[0]) for d, found in asked.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x_ids = batch.column(0).to_numpy()
            for rows, x in _matrix(batch.column(1)):
                if (found := asked.value.get(x.shape[1])) is not None:
                    ids, q, q_table, q_norm, p = found
                    _search(ids, q, q_table, q_norm, x_ids[rows], x, _distances(x, p), (x * x).sum(1), k, best[x.shape[1]])
        for d, found in best.items():
            sizes = [len(s) for s, _ in found]
            cols = [np.repeat(asked.value[d][0], sizes), np.concatenate([i for _, i in found]), np.concatenate([s for s, _ in found]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")
