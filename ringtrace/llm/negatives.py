"""Hard negatives by slots of scores.

An anchor's positives are its nearest rows of its own label; for each, the best rows of other labels are wanted whose
score lies in a window below the positive's.  The windows of one anchor overlap, so negatives are kept by slots instead:
the positives' scores, in descending order, part all scores into disjoint slots, and a row of another label falls into one.  Tasks
keep the k best of each slot, and so do all that combine them.  A window is answered by merging the slots from its own upper limit
downwards.  Anchors go to the tasks in blocks of bounded size, rows stream past them: no row is shuffled, only what tasks keep.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringtrace.llm.common import written
from ringtrace.llm.topk import quantised, usable

#: Bytes of anchors that a task holds at once, and scores that it computes at once.
ANCHOR_BYTES, SCORES = 16 << 20, 1 << 21
LOWEST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Scores that may be multiplied by the window's percentages within 64 bits.
LARGEST = 2.0**52


class Anchors:
    """Anchors of one length: ids, labels, vectors, and after the first pass the limits of their slots, descending."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.limits = np.zeros((len(ids), 0), np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: as floats while they fit their 53 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= LARGEST:
        raise ValueError("inner products beyond 52 bits")
    return (a.astype(float) @ b.astype(float).T).astype(np.int64)


def best_of(score: np.ndarray, valid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, as scores and ids; ``ids`` ascend, so that of equal scores the first counts.  LOWEST fills up."""
    n = score.shape[1]
    if n > k:
        order = np.arange(n - 1, -1, -1)
        if float(np.abs(score).max(initial=0)) * n < 2.0**61:
            at = np.argpartition(np.where(valid, score * n + order, LOWEST), n - k, axis=1)[:, n - k :]
        else:
            at = np.argsort(np.where(valid, -score, NO_ID), axis=1, kind="stable")[:, :k]
    else:
        at = np.broadcast_to(np.arange(n), score.shape)
    fine = np.take_along_axis(valid, at, axis=1)
    return np.where(fine, np.take_along_axis(score, at, axis=1), LOWEST), np.where(fine, ids[at], NO_ID)


def merged(best: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = (np.concatenate(x, axis=1) for x in zip(best, more))
    at = np.lexsort((ids, -np.maximum(score, LOWEST + 1)), axis=1)[:, :k]
    return np.take_along_axis(score, at, axis=1), np.take_along_axis(ids, at, axis=1)


def same_label(a: Anchors, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """The one slot of the first pass: other rows of the anchor's label."""
    return [(labels[None, :] == a.labels[:, None]) & (ids[None, :] != a.ids[:, None])]


def slots(least: tuple[int, int]) -> Callable:
    """The slots of the second pass: rows of other labels at or below a limit and above the next one; ``least`` is the part (of, in) of the
    slot's limit below which no window reaches."""

    def parts(a: Anchors, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        other, out = labels[None, :] != a.labels[:, None], []
        for i in range(a.limits.shape[1]):
            high = a.limits[:, i][:, None]
            low = a.limits[:, i + 1][:, None] if i + 1 < a.limits.shape[1] else LOWEST
            out.append(other & (score <= high) & (score > low) & (least[1] * score >= least[0] * high))
        return out

    return parts


def _streamed(vectors: DataFrame, groups: dict[int, Anchors], parts: Callable, n_parts: int, k: int) -> DataFrame:
    """anchor_id, vec_id, score: of each task, anchor and slot the ``k`` best rows."""
    held = vectors.sparkSession.sparkContext.broadcast(groups)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = held.value
        best = {d: [(np.full((len(a.ids), 0), LOWEST), np.full((len(a.ids), 0), NO_ID)) for _ in range(n_parts)] for d, a in groups.items()}
        for batch in batches:
            lists = batch.column(2)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            all_ids, all_labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for d in set(sizes.tolist()) & groups.keys():
                a, mine = groups[d], np.flatnonzero(sizes == d)
                mine = mine[np.argsort(all_ids[mine])]
                step = max(1, SCORES // max(1, len(a.ids)))
                for some in (mine[x : x + step] for x in range(0, len(mine), step)):
                    ids, labels, x = all_ids[some], all_labels[some], flat[starts[some][:, None] + np.arange(d)]
                    score = scores(a.vectors, x)
                    for p, valid in enumerate(parts(a, score, ids, labels)):
                        best[d][p] = merged(best[d][p], best_of(score, valid, ids, k), k)
        for d, a in groups.items():
            for score, ids in best[d]:
                row, at = np.nonzero(ids != NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(a.ids[row]), pa.array(ids[row, at]), pa.array(score[row, at])], ["anchor_id", "vec_id", "score"])

    return vectors.mapInArrow(rows, "anchor_id bigint, vec_id bigint, score bigint")


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def _grouped(rows: list) -> dict[int, Anchors]:
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r.vec_id):
        out.setdefault(len(r.v), []).append(r)
    return {d: Anchors(np.array([r.vec_id for r in x]), np.array([r.label for r in x]), np.array([r.v for r in x], np.int64).reshape(len(x), d)) for d, x in out.items()}


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), scale: int = 256, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, over ``vectors`` (vec_id, label, embedding).

    Anchors are the rows that ``anchors`` picks.  A row's score is its inner product with the anchor, components being
    floor(``scale`` * x).  Positives are the first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of other labels from ``least`` (a part: of, in) of the positive's score up to it.  Higher scores come first, of equal
    ones the smaller vec_id.  A positive without such rows has none; below a score of 0 no window holds anything.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part; vectors of other lengths than the
    anchor's do not meet it.  Rows that repeat a vec_id count once (the greatest label, then vector).  An empty table gives an
    empty one.  Other columns are not read, but by ``anchors``.  Each block of anchors (``anchor_bytes`` at most, on average) reads the vectors twice.
    """
    fine = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    rows = fine.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.struct(F.col("label").cast("bigint").alias("label"), quantised(F.col("embedding"), scale).alias("v")).alias("row"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = rows.groupBy("vec_id").agg(F.max("row").alias("row"), F.max("is_anchor").alias("is_anchor")).select("vec_id", "row.label", "row.v", "is_anchor")
    table = written(rows, "vectors")
    chosen = table.filter("is_anchor").select("vec_id", "label", "v")
    size = chosen.agg(F.coalesce(F.sum(8 * F.size("v") + 64), F.lit(0)).alias("n")).first().n
    blocks, out = max(1, math.ceil(size / anchor_bytes)), None
    for b in range(blocks):
        groups = _grouped(chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect())  # a block of bounded size
        stream = table.select("vec_id", "label", "v")
        near = written(_first(_streamed(stream, groups, same_label, 1, positives), ["anchor_id"], positives), "positives")
        limits: dict[int, list[int]] = {}
        for r in near.select("anchor_id", "score").collect():  # ``positives`` rows an anchor of the block
            limits.setdefault(r.anchor_id, []).append(r.score)
        for a in groups.values():
            own = [sorted(set(limits.get(i, [])), reverse=True) for i in a.ids.tolist()]
            a.limits = np.array([x + [-int(LARGEST)] * (positives - len(x)) for x in own], np.int64).reshape(len(own), positives)
        kept = _streamed(stream, groups, slots(least), positives, negatives)
        # a limit's slot is told by the scores in it
        upper = near.select("anchor_id", F.col("score").alias("upper")).groupBy("anchor_id").agg(F.array_sort(F.collect_set("upper")).alias("uppers"))
        slot = F.array_min(F.filter("uppers", lambda u: u >= F.col("score")))
        in_slots = _first(kept.join(upper, "anchor_id").withColumn("slot", slot), ["anchor_id", "slot"], negatives)
        # at most positives x negatives rows an anchor, descending: a window's rows stand together, from its upper limit down
        suffix = in_slots.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("kept"))
        pairs = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(suffix, "anchor_id")
        p = F.col("positive_score")
        window = F.filter("kept", lambda x: (-x["down"] <= p) & (-x["down"] * least[1] >= p * least[0]))
        found = pairs.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(window, 1, negatives)).alias("rank", "n"))
        found = found.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))
        out = found if out is None else out.unionByName(found)
    return out
