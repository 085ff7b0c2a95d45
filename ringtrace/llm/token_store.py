"""Token-id output: whole texts as ids in compressed, checksummed blocks, in doc_id order.

A store is a Parquet folder with one row a block: ``part`` and ``block`` (their order is the
order of doc_id), the block's ``doc_ids`` and ``counts`` (ids of each document), ``tokens``
(their sum) and ``payload``, a block of :mod:`coder`.  Blocks are independent: each is decoded
alone, and each carries a checksum.  A block closes at the first document end at or beyond
``block_ids``, so it never needs more memory than that and one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringtrace.llm import coder, wordpiece
from ringtrace.llm.common import bases

BLOCKS = "part int, block int, doc_ids array<bigint>, counts array<bigint>, tokens bigint, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, block_ids: int = coder.BLOCK_IDS, end_id: int = wordpiece.END_ID) -> None:
    """Write ``docs`` (doc_id, text) to a store at ``path``.

    A null or empty text gives the end id alone; a null doc_id sorts first and is kept; repeated
    ids are separate documents, in any order; an empty table gives an empty store.
    """
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, encode = TaskContext.get().partitionId(), 0, wordpiece.encoder(tokenizer).encode
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            row = [[part], [block], [[d for d, _ in held]], [[len(x) // 4 for _, x in held]], [len(ids)], [coder.encode(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "block", "doc_ids", "counts", "tokens", "payload"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at, doc in enumerate(batch.column(0).to_pylist()):
                held.append((doc, encode([texts[at].as_py()])[0] + end))
                size += len(held[-1][1]) // 4
                if size >= block_ids:
                    yield closed()
                    held, size, block = [], 0, block + 1
        if held:
            yield closed()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, wanted: str = "doc_id bigint, ids binary") -> DataFrame:
    """The documents of a store: part, block, doc_id, local_start (ids of its block before it), ids (uint32 bytes)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["payload"])
                ends = np.cumsum(row["counts"], dtype=np.int64)
                starts = ends - np.array(row["counts"], np.int64)
                n = len(ends)
                if int(ends[-1]) != len(ids):
                    raise ValueError("a block's counts do not add up to its ids")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                    ["part", "block", "doc_id", "local_start", "ids"],
                )

    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(documents, "part int, block int, doc_id bigint, local_start bigint, ids binary")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, block, first: the ids of the whole store before each block (read from counts alone)."""
    sizes = spark.read.schema(BLOCKS).parquet(path).select("part", "block", "tokens")
    parts = bases(sizes.groupBy("part").agg(F.sum("tokens").alias("part_tokens")), "part", "part_tokens", "part_base")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return inside.join(parts.select("part", "part_base"), "part").select("part", "block", (F.col("part_base") + F.col("inside")).alias("first"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a store."""
    docs = read_tokens(spark, path).select("part", "block", "doc_id", "local_start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return docs.join(starts(spark, path), ["part", "block"]).select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
