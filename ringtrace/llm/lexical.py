"""Ranked lexical search by presence masks.

A query's mask of a document has a bit for each of the query's terms that the document holds.  Within a block
of documents, bitmaps of the terms give every document's mask, and equal masks are one group.  The terms of a mask, with
their largest counts in the block and the group's smallest length norm, bound the scores of its documents from above.  Groups are
scored exactly in descending order of that bound, until the k-th best score known lies above the next one; ties are kept.

Documents are read once for a block of queries: counts of the queries' terms go to a table (the statistics come
from it), and the search reads that table.  A task keeps k documents a query, so little is shuffled.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringtrace.llm.common import written

#: Bytes: digits, letters (lower-cased) and all beyond ASCII stay, others part terms.
_KEPT = string.digits + string.ascii_letters
TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b) in _KEPT else 0x20 for b in range(256))
#: Bytes of query texts that are held by a task at once; more queries are taken in blocks.
QUERY_BYTES = 4 << 20
#: Documents of the best groups that are scored at once.
CHUNK = 64
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def _counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tfs (counts of the vocabulary's terms) of documents that have terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, lengths, terms, tfs = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                found = [(at, n) for w, n in Counter(words).items() if (at := vocabulary.get(w)) is not None]
                ids.append(doc)
                sizes.append(len(words))
                lengths.append(len(found))
                terms.extend(at for at, _ in found)
                tfs.extend(n for _, n in found)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Block:
    """Counts of a block of documents, by term: places of its documents, ascending, and counts."""

    def __init__(self, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.norms, self.terms = norms, terms[order]
        self.docs, self.tfs = np.repeat(np.arange(len(norms)), sizes)[order], tfs[order].astype(np.int64)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.terms, [term, term + 1])
        return self.docs[a:b], self.tfs[a:b]


def saturated(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The integer part a count has in a score: grows with the count, falls with the norm."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm)


def masks(postings: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """A row of 64-bit lanes for each document: bit j tells whether it holds term j."""
    lanes = np.zeros((size, max(1, (len(postings) + 63) // 64)), np.uint64)
    for j, (docs, _) in enumerate(postings):
        lanes[docs, j // 64] |= np.uint64(1 << (j % 64))
    return lanes


def block_best(block: Block, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, best: np.ndarray) -> np.ndarray:
    """``best`` (rows of score, id, best first) after a block, for a query of distinct ``terms`` with ``weights``."""
    postings = [block.of(t) for t in terms]
    there = [j for j, (docs, _) in enumerate(postings) if len(docs)]
    postings, weights = [postings[j] for j in there], weights[there]
    if not postings:
        return best
    lanes = masks(postings, len(ids))
    held = np.flatnonzero(lanes.any(axis=1))
    order = held[np.lexsort([block.norms[held], *lanes[held].T])]
    sorted_lanes = lanes[order]
    first = np.flatnonzero(np.concatenate([[True], (sorted_lanes[1:] != sorted_lanes[:-1]).any(axis=1)]))
    ends = np.append(first[1:], len(order))
    # a group's first document has its smallest norm
    most = np.array([tf.max() for _, tf in postings])
    bits = (sorted_lanes[first][:, np.arange(len(postings)) // 64] >> (np.arange(len(postings)) % 64).astype(np.uint64)) & np.uint64(1)
    bounds = (bits.astype(np.int64) * saturated(most[None, :], block.norms[order[first]][:, None])) @ weights
    ranked, at = np.argsort(-bounds, kind="stable"), 0
    while at < len(ranked):
        kth = best[-1, 0] if len(best) == k else 1
        if bounds[ranked[at]] < kth:
            break
        upto = at
        chosen: list[np.ndarray] = []
        while upto < len(ranked) and bounds[ranked[upto]] >= kth and sum(map(len, chosen)) < CHUNK:
            chosen.append(order[first[ranked[upto]] : ends[ranked[upto]]])
            upto += 1
        at, docs = upto, np.sort(np.concatenate(chosen))
        score = np.zeros(len(docs), np.int64)
        for (held_by, tfs), w in zip(postings, weights):
            place = np.minimum(np.searchsorted(held_by, docs), len(held_by) - 1)
            met = held_by[place] == docs
            score[met] += w * saturated(tfs[place[met]], block.norms[docs[met]])
        keep = score >= max(kth, 1)
        rows = np.concatenate([best, np.stack([score[keep], ids[docs[keep]]], axis=1)])
        best = rows[np.lexsort([rows[:, 1], -rows[:, 0]])[:k]]
    return best


def _searched(table: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], k: int, n_docs: int, n_terms: int) -> DataFrame:
    """q, doc_id, score: each task's ``k`` best documents of each query."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((0, 2), np.int64) for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            norms = 75 + 25 * batch.column(1).to_numpy(zero_copy_only=False) * n_docs // n_terms
            terms, tfs = batch.column(2), batch.column(3)
            sizes = np.diff(terms.offsets.to_numpy())
            block = Block(norms, sizes, terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False))
            best = [block_best(block, ids, t, w, k, b) for (t, w), b in zip(queries, best)]
        for q, found in enumerate(best):
            docs = pa.array(found[:, 1], mask=found[:, 1] == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), q, np.int32)), docs, pa.array(found[:, 0])], ["q", "doc_id", "score"])

    return table.mapInArrow(rows, "q int, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 20, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) with a score above 0 for each of ``items`` (item_id, text).

    Null and empty texts have no terms: such documents count for nothing, such items find nothing.  Equal scores go by ascending
    doc_id, null last; a document without an id counts as others do.  Repeated rows of ``docs`` are documents each; rows of ``items`` that
    repeat id and text are one item, and an id with several texts has a ranking for each.  Empty tables give an empty
    one.  Other columns are not read.  ``query_bytes`` bounds the query texts that are on the driver and in a task at once.
    """
    spark = docs.sparkSession
    items = written(items.select("item_id", "text").filter(F.col("text") != "").distinct(), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first().n
    blocks, out = max(1, math.ceil(total / query_bytes)), None
    for b in range(blocks):
        asked = [(r.item_id, Counter(terms_of(r.text.encode()))) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in asked for t in counts}))}
        table = written(_counted(docs, vocabulary), "term-counts")
        sums = table.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = {r.term: r["count"] for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # as many rows as the queries have terms
        weight = {i: math.floor(1000 * math.log((2 * sums.docs + 2) / (2 * n + 1))) for i, n in df.items()}
        queries = []
        for _, counts in asked:
            own = [(i, weight[i] * n) for i, n in ((vocabulary[t], n) for t, n in counts.items()) if weight.get(i, 0) > 0]
            own.sort(key=lambda x: -x[1])
            queries.append((np.array([i for i, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
        ids = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(asked)], f"q int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _searched(table, queries, k, sums.docs, max(sums.terms, 1))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        named = top.join(F.broadcast(ids), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # as many rows as queries
        out = named if out is None else out.unionByName(named)
    return out
