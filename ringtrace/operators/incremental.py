"""Connected components kept up to date batch by batch: the work of a batch follows what it brings.

The state is three append-only tables of a folder, each parted by batch and by a bucket of its key: ``documents`` (document_id, component
when first seen), ``keys`` (key, component when first seen) and ``renames`` (old component, the one it is part of now).  A batch looks up its own
documents and keys, contracts what it finds to the components they are in, joins these few, and appends what is new.  A component that becomes part of another is
renamed by one row, not by one a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringtrace.operators.common import discard, empty, written
from ringtrace.operators.graph import components

SCHEMAS = {"documents": "document_id string, component string", "keys": "key string, component string", "renames": "old string, component string"}


class Components:
    """The components of all edges (document_id, key) of the batches applied so far, in the folder ``root``; ``buckets`` stays the same for one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def _files(self, path: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []

    def _table(self, name: str, before: int | None) -> DataFrame:
        """A table of the state, with batch and bucket, as of all batches before ``before``."""
        path = f"{self.root}/{name}"
        numbers = [int(f.split("=")[1]) for f in self._files(path) if f.startswith("batch=")]
        chosen = [f"{path}/batch={n}" for n in sorted(numbers) if before is None or n < before]
        schema = f"{SCHEMAS[name]}, batch int, bucket int"
        if not chosen:
            return empty(self.spark, schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(*chosen)

    def _append(self, name: str, batch: int, rows: DataFrame) -> None:
        key = SCHEMAS[name].split()[0]
        # a bucket's rows of a batch lie in one file
        rows.withColumn("bucket", self._bucket(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/batch={batch}")

    def _looked_up(self, name: str, wanted: DataFrame, before: int | None) -> DataFrame:
        """Rows of the state for the keys of ``wanted`` (one column): the join on the bucket lets Spark skip the others' files."""
        key = wanted.columns[0]
        return wanted.withColumn("bucket", self._bucket(key)).join(self._table(name, before), [key, "bucket"])

    def _now(self, name: str, wanted: DataFrame, before: int | None) -> DataFrame:
        """Known keys of ``wanted`` with the component they are in now."""
        first = self._looked_up(name, wanted, before).select(wanted.columns[0], F.col("component").alias("old"))
        moved = self._renamed(first.select("old").distinct(), before)
        return first.join(moved, "old", "left").select(wanted.columns[0], F.coalesce("component", "old").alias("component"))

    def _renamed(self, wanted: DataFrame, before: int | None) -> DataFrame:
        """old, component of those that were renamed: the latest name counts."""
        rows = self._looked_up("renames", wanted, before)
        return rows.groupBy("old").agg(F.max_by("component", "batch").alias("component"))

    def apply(self, batch: int, edges: DataFrame) -> DataFrame:
        """Add a batch of edges; returns old, component of the components that became part of others.

        A batch of the same number replaces what it left before: a batch that broke off is run again.
        Null documents and keys are left out; repeated edges count once.
        """
        new = written(edges.select("document_id", "key").dropna().distinct(), "batch-edges")
        docs = written(self._now("documents", new.select("document_id").distinct(), batch), "known-documents")
        keys = written(self._now("keys", new.select("key").distinct(), batch), "known-keys")
        # a document stands for itself until it is known, a key for the first document of its batch
        nodes = new.join(docs.withColumnRenamed("component", "of_doc"), "document_id", "left").withColumn("node", F.coalesce("of_doc", "document_id"))
        least = nodes.groupBy("key").agg(F.min("node").alias("first"))
        placed = least.join(keys.withColumnRenamed("component", "of_key"), "key", "left").select("key", F.col("of_key").isNotNull().alias("known"), F.coalesce("of_key", "first").alias("key_node"))
        ends = written(nodes.join(placed, "key").select("document_id", F.col("of_doc").isNotNull().alias("known_doc"), "node", "key", "known", "key_node"), "contracted")
        links = ends.filter("node <> key_node").select(F.col("node").alias("a"), F.col("key_node").alias("b")).distinct()
        joined = written(components(links).select(F.col("document_id").alias("node"), F.col("component").alias("root")), "joined")
        root = lambda df, of: df.join(joined.withColumnRenamed("node", of), of, "left").withColumn("root", F.coalesce("root", of))
        self._append("documents", batch, root(ends.filter("NOT known_doc"), "node").select("document_id", F.col("root").alias("component")).distinct())
        self._append("keys", batch, root(ends.filter("NOT known"), "key_node").select("key", F.col("root").alias("component")).distinct())
        was = docs.select("component").unionByName(keys.select("component")).distinct()
        moved = written(was.join(joined, F.col("component") == F.col("node")).filter("component <> root").select(F.col("component").alias("old"), F.col("root").alias("component")), "moved")
        # what was renamed to a component that is now part of another follows it
        current = self._table("renames", batch).groupBy("old").agg(F.max_by("component", "batch").alias("middle"))
        followed = current.join(moved.select(F.col("old").alias("middle"), "component"), "middle").select("old", "component")
        self._append("renames", batch, moved.unionByName(followed))
        discard(new, docs, keys, ends, joined)
        return moved

    def current(self, before: int | None = None) -> DataFrame:
        """document_id, component of all documents that share an indicator with others."""
        names = self._table("renames", before).groupBy("old").agg(F.max_by("component", "batch").alias("renamed"))
        docs = self._table("documents", before).join(names, F.col("component") == F.col("old"), "left").select("document_id", F.coalesce("renamed", "component").alias("component"))
        several = docs.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
        return docs.join(several, "component", "left_semi").select("document_id", "component")
