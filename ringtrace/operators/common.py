"""Shared helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; in local mode one of our own where it is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        chosen = context._jsc.sc().getCheckpointDir()
        if chosen.isEmpty():
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            chosen = context._jsc.sc().getCheckpointDir()
        root = chosen.get()
    return root.rstrip("/")


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and it survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._is_written = True
    return out


def kept(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` itself if it is a table of :func:`written`, else as one."""
    return df if getattr(df, "_is_written", False) else written(df, name)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written`; all that reads them must be written by now."""
    for table in tables:
        spark = table.sparkSession
        for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def best(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (end it with something unique)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def sorted_set(c: Column | str) -> Column:
    return F.array_sort(F.collect_set(c))


def joined_text(c: Column | str) -> Column:
    """An array as text, for flat results."""
    return F.array_join(c, ",")


def digest(c: Column | str) -> Column:
    """Of a set of texts, whatever their order: the exclusive or of 60 bits of each one's md5.  It needs no list of them."""
    return F.bit_xor(F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("bigint"))


def listed(rows: DataFrame, keys: list[str], value: str, name: str, size: int = 1000) -> DataFrame:
    """keys, part, ``name``: every different ``value`` of each group, in order, as text.

    A group of up to ``size`` values is one part, 0; a larger one is dealt over parts of some ``size`` by its values' md5, so that no row
    and no task holds a hot group whole.
    """
    values = rows.select(*keys, value).distinct()
    large = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size).select(*keys, F.ceil(F.col("_n") / F.lit(size)).alias("_parts"))
    part = F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint") % F.coalesce("_parts", F.lit(1))
    return values.join(large, keys, "left").withColumn("part", part).groupBy(*keys, "part").agg(joined_text(sorted_set(value)).alias(name))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
