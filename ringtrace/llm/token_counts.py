"""Delta-maintained rollups of token counts by source, language and tokenizer version.

Each batch of changes becomes signed rows that are summed by key into the batch's own folder
of a store; the totals are the sum over batches, so no stored total is ever rewritten.
A batch's folder is its commit: it appears whole or not at all, and a batch that is sent again
changes nothing (idempotent).

Changes: insert (adds a document and its count), delete (takes both away), revise (adds the
difference of a new count and the old one under the same key).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringtrace.llm import bpe, wordpiece

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def signed(changes: DataFrame) -> DataFrame:
    """Additive rows of ``changes`` (op, source, lang, tokenizer, n_tokens, old_tokens); another op is an error.

    Null counts are 0; null sources, languages and tokenizers are keys of their own.
    """
    new, old = F.coalesce("n_tokens", F.lit(0)).cast("bigint"), F.coalesce("old_tokens", F.lit(0)).cast("bigint")
    documents = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).otherwise(new - old)
    return changes.select(*KEYS, documents.cast("bigint").alias("documents"), tokens.alias("tokens"))


def commit(store: str, batch: int, changes: DataFrame) -> bool:
    """Add batch number ``batch`` to the store; False, and nothing done, if it is there already.

    The batch is written beside its place and then renamed to it, so that readers see all of it or
    nothing, and a batch that is sent again never touches the one that counts.
    """
    spark = changes.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    place, beside = jvm.Path(f"{store}/batch-{int(batch):012d}"), jvm.Path(f"{store}/_new-{uuid.uuid4().hex}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place):
        return False
    rollup = signed(changes).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    rollup.filter("documents <> 0 OR tokens <> 0").write.parquet(str(beside))
    if fs.exists(place) or not fs.rename(beside, place):
        fs.delete(beside, True)
        return False
    return True


def committed(spark: SparkSession, store: str) -> list[int]:
    """The numbers of the batches that were written to their end."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(store)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(m[1]) for p in found if (m := re.fullmatch(r"batch-(\d+)", p.getName())) and fs.exists(jvm.Path(p, "_SUCCESS")))


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, tokenizer, documents, tokens over all committed batches; keys without documents or tokens go."""
    paths = [f"{store}/batch-{b:012d}" for b in committed(spark, store)]
    rows = spark.read.schema(DELTAS).parquet(*paths) if paths else spark.createDataFrame([], DELTAS)
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 OR tokens <> 0")


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Write the totals of ``store`` to a new store as its batch 0, if its batches have become many."""
    totals(spark, store).write.mode("overwrite").parquet(f"{target}/batch-{0:012d}")


def counted(docs: DataFrame, versions: dict[str, str], pattern: str) -> DataFrame:
    """source, lang, tokenizer, n_tokens, old_tokens, revised of ``docs`` (source, lang, text, new_text): a row for each document and version.

    ``versions`` names vocabulary files by tokenizer version: a .json of the word-level tokenizer, a
    .tiktoken of a byte-level one (whose words ``pattern`` cuts).  ``old_tokens`` counts the whole text (null: none),
    ``n_tokens`` the whole new text, where there is one (null otherwise).  Every row is counted, also
    those that repeat others or have no id.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        def counter(path: str) -> Callable[[list[str]], list[int]]:
            if path.endswith(".json"):
                encoder = wordpiece.encoder(path)
                return lambda texts: [len(x) // 4 for x in encoder.encode([t.encode() for t in texts])]
            encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
            return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]

        counters = {name: counter(path) for name, path in versions.items()}
        for batch in batches:
            texts, new = (batch.column(k).to_pylist() for k in (2, 3))
            at = [k for k, x in enumerate(new) if x is not None]
            for name, count in counters.items():
                revised: list[int | None] = [None] * len(new)
                for k, n in zip(at, count([new[k] for k in at])):
                    revised[k] = n
                old = count([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([name] * len(old)), pa.array(revised, pa.int64()), pa.array(old, pa.int64())], ["source", "lang", "tokenizer", "n_tokens", "old_tokens"])

    return docs.select("source", "lang", "text", "new_text").mapInArrow(rows, "source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint")


def without_repeated_lines(text: Column) -> Column:
    """The text with every line once, or null if no line repeats."""
    lines = F.split(text, "\n")
    return F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.array_join(F.array_distinct(lines), "\n"))
