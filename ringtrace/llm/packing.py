"""Concatenate and cut: all documents' ids as one stream, cut into windows of fixed length.

First pass: ids are written once, with each document's offset within its partition.  The
partition totals' prefix sums then give every document its place in the stream without
moving any ids, and the second pass cuts each document where a window ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringtrace.llm import wordpiece
from ringtrace.llm.common import bases, slices, written

WINDOW = 4096
#: Partition totals are broadcast up to so many rows (16 bytes each), and joined by shuffle beyond.
BROADCAST_PARTS = 200_000

IDS = "part int, local_start bigint, doc_id bigint, n_tokens bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, continued boolean, ids binary"


def token_stream(docs: DataFrame, tokenizer: str, end_id: int = wordpiece.END_ID) -> DataFrame:
    """The ids of ``docs`` (doc_id, text), written: part, local_start, doc_id, n_tokens, ids.

    Ids are stored as little-endian uint16 where the vocabulary allows (all of the public
    word-level one).  A null or empty text gives the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, at = TaskContext.get().partitionId(), wordpiece.encoder(tokenizer).encode, 0
        for batch in slices(batches):
            ids = [x + end for x in encode(batch.column(1).cast(pa.binary()).to_pylist())]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            ends = at + np.cumsum(sizes)
            wide = np.frombuffer(b"".join(ids), "<u4")
            if len(wide) and int(wide.max()) > 0xFFFF:
                raise ValueError("the vocabulary has ids beyond uint16")
            cuts = np.concatenate([[0], np.cumsum(sizes * 2)]).astype(np.int32)
            narrow = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cuts), pa.py_buffer(wide.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(ends - sizes), batch.column(0).cast(pa.int64()), pa.array(sizes), narrow], ["part", "local_start", "doc_id", "n_tokens", "ids"])
            at = int(ends[-1]) if len(ends) else at

    return written(docs.select("doc_id", "text").mapInArrow(encoded, IDS), "packing-ids")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = wordpiece.END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): one row for each part of a document in one window.

    doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens,
    sequence_id, offset (place in the sequence), continued (a boundary record: the document
    goes on in the next sequence), ids (uint32 bytes; null without ``with_ids``).  All sequences
    are full but the last one.  A null doc_id is kept; repeated ids are separate documents;
    an empty table gives no pieces.
    """
    stream = token_stream(docs, tokenizer, end_id)
    totals = bases(stream.groupBy("part").agg(F.sum("n_tokens").alias("tokens")), "part", "tokens").select("part", "base")
    totals = written(totals, "packing-bases")
    if totals.count() <= BROADCAST_PARTS:
        totals = F.broadcast(totals)
    placed = stream.join(totals, "part").select("doc_id", "n_tokens", (F.col("base") + F.col("local_start")).alias("first"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, first = (batch.column(k).to_numpy() for k in (1, 2))
            runs = (first + n - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(n)), runs)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
            sequence = first[row] // window + nth
            begin = np.maximum(first[row], sequence * window)
            stop = np.minimum(first[row] + n[row], (sequence + 1) * window)
            start = begin - first[row]
            wide = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").astype("<u4").tobytes()
            origin = np.cumsum(n) - n
            a = (origin[row] + start) * 4
            pieces = [wide[x:y] for x, y in zip(a.tolist(), (a + (stop - begin) * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(stop - begin), pa.array([zlib.crc32(x) for x in pieces], pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * window), pa.array(start + (stop - begin) < n[row]), pa.array(pieces if with_ids else [None] * len(pieces), pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "continued", "ids"],
            )

    return placed.mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Whole sequences: sequence_id, ids (their pieces in order), length, padded (tokens to pad to)."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))  # a sequence has ``window`` pieces at most
    whole = pieces.groupBy("sequence_id").agg(rows.alias("rows"))
    length = F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, x: s + x["length"])
    power = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(length, F.lit(1)))))
    ids = F.unhex(F.array_join(F.transform("rows", lambda x: F.hex(x["ids"])), ""))
    return whole.select("sequence_id", ids.alias("ids"), length.alias("length"), F.when(length == power, length).otherwise(F.lit(window)).cast("bigint").alias("padded"))
