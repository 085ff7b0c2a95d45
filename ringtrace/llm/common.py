"""Shared helpers: table access, shared scratch tables, exact prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: ASCII white space, as a Java character class: the word separators of all contracts.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in local mode where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get()
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While it lasts, a query's shuffle files go when the query ends: what it made is written by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` (or plain selections from one); all that reads them must be written by now."""
    for table in tables:
        spark = table.sparkSession
        for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches`` in smaller ones: a task's whole share may be one batch, of which numpy makes arrays many times its size."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def bases(totals: DataFrame, key: str, amount: str, out: str = "base", fan: int = 4096) -> DataFrame:
    """Exclusive prefix sums of ``amount`` in the order of the non-negative integer ``key``, one row a key.

    Two levels: sums within runs of ``fan`` keys run in parallel, and only one row a run
    goes through the single ordered pass.
    """
    runs = totals.withColumn("run", F.floor(F.col(key) / F.lit(fan)))
    inside = Window.partitionBy("run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        runs.groupBy("run")
        .agg(F.sum(amount).alias("in_run"))
        .withColumn("before", F.coalesce(F.sum("in_run").over(across), F.lit(0)))
        .select("run", "before")
    )
    return (
        runs.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(before, "run")
        .withColumn(out, (F.col("inside") + F.col("before")).cast(T.LongType()))
        .drop("inside", "before", "run")
    )
