"""A keyed table on files with versions: an upsert rewrites only the buckets that its keys fall into.

Rows lie in buckets by a hash of their key.  A version is a manifest, a small file that names the folder of every bucket; it is written last and
never changed.  Readers take the highest complete version, so a writer that breaks off leaves the table as it was.  Two writers of
the same version do not both succeed.  Folders that no kept version names are removed by :func:`vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringtrace.operators import registry
from ringtrace.operators.common import empty


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    where, files = _path(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: it is written under another name and renamed; an existing one is an error."""
    where, files = _path(spark, path)
    draft, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if files.exists(where) or not files.rename(draft, where):
        files.delete(draft, False)
        raise FileExistsError(f"another writer made {path}")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, ascending."""
    return [int(n.removesuffix(".json")) for n in names(spark, f"{root}/manifest") if n.endswith(".json") and n.removesuffix(".json").isdigit()]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """number, keys, buckets, schema and the folder of each bucket that has rows; of the highest version unless one is named."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no table in {root}")
    number = known[-1] if version is None else version
    row = spark.read.text(f"{root}/manifest/{number:012d}.json", wholetext=True).first()
    return json.loads(row.value)


def read(spark: SparkSession, root: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The table as of a version (all buckets, or those of ``only``)."""
    return _read(spark, root, manifest(spark, root, version), only)


def _read(spark: SparkSession, root: str, held: dict, only: list[int] | None = None) -> DataFrame:
    folders = [f"{root}/{folder}" for b, folder in held["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(held["schema"]).parquet(*folders) if folders else empty(spark, held["schema"])


def _written(df: DataFrame, root: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Write ``df`` by buckets to a folder of its own; the folders of the buckets that have rows."""
    spark, name = df.sparkSession, f"data/{uuid.uuid4().hex}"
    # one file a bucket; a hot bucket is as large as its keys
    df.withColumn("_bucket", bucket_of(keys, buckets)).repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{root}/{name}")
    return {f.split("=")[1]: f"{name}/{f}" for f in names(spark, f"{root}/{name}") if f.startswith("_bucket=")}


def create(df: DataFrame, root: str, keys: list[str], buckets: int = 64) -> int:
    """Write ``df``, whose keys are unique, as version 0 of a new table."""
    spark = df.sparkSession
    if versions(spark, root):
        raise FileExistsError(f"there is a table in {root}")
    held = {"number": 0, "keys": keys, "buckets": buckets, "schema": df._jdf.schema().toDDL(), "folders": _written(df, root, keys, buckets)}
    put(spark, f"{root}/manifest/{0:012d}.json", json.dumps(held))
    return 0


def upsert(new: DataFrame, root: str, protected: list[str] = (), before_commit=None) -> int:
    """Merge ``new`` by the table's keys (as registry.upsert does) and return the new version; an empty ``new`` makes none.

    Buckets without a key of ``new`` are neither read nor written.  Columns must be those of the table.  ``before_commit`` is called when all data are written.
    """
    spark = new.sparkSession
    held = manifest(spark, root)
    keys, n = held["keys"], held["buckets"]
    touched = [r.b for r in new.select(bucket_of(keys, n).alias("b")).distinct().collect()]  # as many as buckets, at most
    if not touched:
        return held["number"]
    old = _read(spark, root, held, touched)
    if unknown := set(new.columns) - set(old.columns):
        raise ValueError(f"columns that the table lacks: {sorted(unknown)}")
    rows = registry.upsert(old, new, keys, protected).select(*[F.col(f.name).cast(f.dataType) for f in old.schema.fields])
    folders = held["folders"] | _written(rows, root, keys, n)
    if before_commit is not None:
        before_commit()
    number = held["number"] + 1
    put(spark, f"{root}/manifest/{number:012d}.json", json.dumps(held | {"number": number, "folders": folders}))
    return number


def replace(df: DataFrame, root: str, before_commit=None) -> int:
    """A whole new snapshot as the next version: readers see the one before until its manifest is there."""
    spark, held = df.sparkSession, manifest(df.sparkSession, root)
    folders = _written(df, root, held["keys"], held["buckets"])
    if before_commit is not None:
        before_commit()
    number = held["number"] + 1
    put(spark, f"{root}/manifest/{number:012d}.json", json.dumps(held | {"number": number, "folders": folders, "schema": df._jdf.schema().toDDL()}))
    return number


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete versions but the ``keep`` latest, and data folders that no kept version names; no writer may be at work."""
    known = versions(spark, root)
    used = {folder.split("/")[1] for v in known[-keep:] for folder in manifest(spark, root, v)["folders"].values()}
    gone = [f"{root}/manifest/{v:012d}.json" for v in known[:-keep]] + [f"{root}/data/{d}" for d in names(spark, f"{root}/data") if d not in used]
    for path in gone:
        where, files = _path(spark, path)
        files.delete(where, True)
    return gone
