"""Exact top-k inner products by multi-resolution segment statistics.

A vector's segments have a mean and a deviation (root of the summed squares about the mean).
Over a segment of length l, sum((q-x)^2) >= l*(mq-mx)^2 + (dq-dx)^2, the lower bound on the
distance; as q.x = (|q|^2 + |x|^2 - distance) / 2, the same statistics bound the inner product
from above by l*mq*mx + dq*dx.  Levels go from one segment to many: each level drops the
candidates whose bound lies below the k-th best exact score known so far, and only survivors
of the finest level are multiplied out.  Queries and candidates meet in blocks; a block's
k best leave it, and a window picks the k best of all blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringtrace.llm.common import written

LEVELS = (1, 4, 16)
#: Vectors in a block at most, on average.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192
#: Candidates scored exactly at each level for each query, to have a k-th best score.
PROBES = 64

RESULT = "query_id bigint, vec_id bigint, score bigint"


def usable(vector: Column) -> Column:
    """Not null, and neither null nor non-finite in any component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, and the segments' lengths."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(cuts).astype(float)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    spread = np.maximum(np.add.reduceat(x * x, cuts[:-1], axis=1) - size * mean * mean, 0)
    return mean, np.sqrt(spread), size


def _bounds(x: np.ndarray, scaled: bool) -> list[np.ndarray]:
    out = []
    for n in LEVELS:
        mean, spread, size = statistics(x, n)
        out.append(np.hstack([mean * size if scaled else mean, spread]))
    return out


def block_top(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best candidates of a block: query ids, candidate ids, scores.  x_ids ascend.

    Each level, from coarse to fine, bounds the candidates that are left, scores the most promising of
    them exactly, and drops those whose bound lies below the k-th best exact score known by then.
    """
    if x.shape[1] == 0 or not len(x):
        pairs = [(a, b, 0) for a in q_ids.tolist() for b in [i for i in x_ids.tolist() if i != a][:k]]
        return tuple(np.array([p[n] for p in pairs], np.int64) for n in range(3))
    qf, xf = q.astype(float), x.astype(float)
    q_stats, x_stats = _bounds(qf, True), _bounds(xf, False)
    # float error of a bound: far below this part of the largest product
    slack = 1e-9 * (1 + np.sqrt((qf * qf).sum(1)) * math.sqrt(float((xf * xf).sum(1).max())))
    own = {i: at for at, i in enumerate(x_ids.tolist())}
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(len(q)):
        mine, kth = own.get(int(q_ids[at])), -math.inf
        left = np.arange(len(x)) if mine is None else np.delete(np.arange(len(x)), mine)
        for a, b in zip(q_stats, x_stats):
            bound = b[left] @ a[at]
            heads = np.argpartition(-bound, PROBES - 1)[:PROBES] if len(left) > PROBES else slice(None)
            known = xf[left[heads]] @ qf[at]
            if len(known) >= k:
                kth = max(kth, float(np.partition(known, len(known) - k)[len(known) - k]))
            left = left[bound >= kth - 2 * slack[at]]
        score = x[left] @ q[at]
        best = np.lexsort((x_ids[left], -score))[:k]
        found.append((np.full(len(best), q_ids[at]), x_ids[left][best], score[best]))
    return tuple(np.concatenate([f[n] for f in found]) for n in range(3))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` (vec_id, embedding) for each of ``queries`` (the same columns).

    A query's own vec_id is no candidate; ties go to the smaller vec_id.  Vectors that are null,
    or hold null or non-finite components, take no part, nor does a null vec_id; vectors of other
    lengths than the query's are no candidates of it.  Repeated rows of one vec_id count once
    (the greatest vector).  An empty side gives no rows.  Components whose products could leave
    64 bits raise an error.
    """
    unique = lambda df: df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.max(quantised(F.col("embedding"), scale)).alias("v"))
    x, q = written(unique(vectors), "vectors"), written(unique(queries), "queries")
    x_blocks = max(1, math.ceil(x.count() / CANDIDATE_BLOCK))
    q_blocks = max(1, math.ceil(q.count() / QUERY_BLOCK))
    # each candidate goes to every block of queries and each query to every block of candidates
    dealt_x = x.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(x_blocks)).alias("xb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))).alias("qb"))
    dealt_q = q.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(x_blocks - 1).cast("bigint"))).alias("xb"))

    def matched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        right = right.sort_values("vec_id")
        for size, some in left.groupby(left["v"].map(len)):
            same = right[right["v"].map(len) == size]
            if len(same):
                a, b = np.stack(some["v"].to_list()).astype(np.int64), np.stack(same["v"].to_list()).astype(np.int64)
                if size and float(np.abs(a).max()) * float(np.abs(b).max()) * size >= 2.0**62:
                    raise ValueError("inner products beyond 64 bits")
                got = block_top(some["vec_id"].to_numpy(), a, same["vec_id"].to_numpy(), b, k)
                out.append(pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got))))
        return pd.concat(out)

    best = dealt_q.groupBy("qb", "xb").cogroup(dealt_x.groupBy("qb", "xb")).applyInPandas(matched, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
