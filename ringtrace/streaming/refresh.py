"""Continuous refresh: new hits in, the campaign graph recomputed after each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ringtrace.operators.incremental import Components

CYCLE, LATE = "15 minutes", "5 minutes"


def cycle_counts(stream: DataFrame, at: str = "at", key: str = "job_id") -> DataFrame:
    """Hits by cycle and key; a cycle stays open for hits that are ``LATE`` at most."""
    return stream.withWatermark(at, LATE).groupBy(F.window(at, CYCLE).alias("cycle"), key).agg(F.count(F.lit(1)).alias("hits")).select(F.col("cycle.start").alias("cycle_start"), key, "hits")


def lookback_counts(stream: DataFrame, at: str = "at", keys: list[str] = ("url_key",), interval: int = 15, overlap: int = 5, late: str = LATE) -> DataFrame:
    """cycle_start, cycle_end, keys, hits: a cycle ends every ``interval`` minutes and looks back over these and ``overlap`` more.

    Cycles overlap, so a hit near a boundary counts in both, and one that came late for its own is seen by the next.  On a
    stream a cycle is told once it can gain no more hits.
    """
    if interval < 1 or overlap < 0:
        raise ValueError("interval from 1 minute, overlap from 0")
    # windows start where a cycle that ends at a multiple of the interval begins to look back
    start = -(interval + overlap) % interval
    cycle = F.window(at, f"{interval + overlap} minutes", f"{interval} minutes", f"{start} minutes")
    counts = stream.withWatermark(at, late).groupBy(cycle.alias("cycle"), *keys).agg(F.count(F.lit(1)).alias("hits"))
    return counts.select(F.col("cycle.start").alias("cycle_start"), F.col("cycle.end").alias("cycle_end"), *keys, "hits")


def once(stream: DataFrame, at: str = "at", keys: list[str] = ("url_key",)) -> DataFrame:
    """Repeats within the watermark are dropped; :func:`fresh` drops those against all earlier batches."""
    return stream.withWatermark(at, LATE).dropDuplicatesWithinWatermark(list(keys))


def fresh(batch: DataFrame, registry: DataFrame, key: str = "url_key") -> DataFrame:
    """Hits of a batch whose address is not registered yet, once each (the first)."""
    first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct("at", "event_id")).alias("r")).select("r.*")
    return first.join(registry.select(key), key, "left_anti")


def seen(stream: DataFrame, at: str = "at", key: str = "url_key") -> DataFrame:
    """First and last time of each key over all batches (update mode)."""
    return stream.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("hits"))


def refreshing(stream: DataFrame, edges_path: str, checkpoint: str, refresh: Callable[[DataFrame], None], key: str = "url_key") -> DataStreamWriter:
    """A writer that adds each batch's new edges and calls ``refresh`` with all of them.

    A batch writes to a folder of its own number, so that a batch that runs twice leaves its
    rows once; uniqueness of keys is against all other batches.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(edges_path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        folders = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        earlier = [f"{edges_path}/{f}" for f in folders if f.startswith("batch-") and f != f"batch-{number:09d}"]
        known = spark.read.schema(batch.schema).parquet(*earlier) if earlier else batch.limit(0)
        fresh(batch, known, key).write.mode("overwrite").parquet(f"{edges_path}/batch-{number:09d}")
        refresh(spark.read.schema(batch.schema).parquet(*earlier, f"{edges_path}/batch-{number:09d}"))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def refreshing_components(stream: DataFrame, root: str, checkpoint: str, refresh: Callable[[DataFrame, Components], None]) -> DataStreamWriter:
    """A writer that adds each batch's edges (document_id, key) to the components in ``root``.

    Only what a batch touches is joined anew (:class:`Components`); ``refresh`` gets the batch's renamed components and the state.
    A batch that runs twice replaces what it left.
    """

    def take(batch: DataFrame, number: int) -> None:
        state = Components(batch.sparkSession, root)
        refresh(state.apply(number, batch), state)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
