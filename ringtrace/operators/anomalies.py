"""Anomalies: severe documents, repeated indicators, large components.

An anomaly is a row of counts; what it rests on is a table of its own, a row for each document and
each indicator, as a hot indicator or a giant component has more of them than a row should hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringtrace.functions import fixed
from ringtrace.operators.common import best, discard, written

#: The order in which kinds are shown.
ORDER = ["high_severity", "repeated_indicator", "burst_size"]


def _rows(df: DataFrame, kind: str, of: Column, observed: Column, threshold: int, documents: Column, campaign: Column | None = None, key: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.concat(F.lit(f"{kind}_"), of).alias("anomaly_key"),
        F.lit(kind).alias("anomaly_type"),
        observed.cast("double").alias("observed"),
        F.lit(float(threshold)).alias("threshold"),
        documents.cast("bigint").alias("document_count"),
        (none if campaign is None else campaign).alias("campaign_key"),
        (none if key is None else key).alias("indicator_key"),
    )


def _short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def found(docs: DataFrame, edges: DataFrame, clusters: DataFrame, severity: int = fixed.HIGH_SEVERITY, repeats: int = fixed.REPEATED_INDICATOR, burst: int = fixed.BURST_SIZE) -> DataFrame:
    """All three kinds: ``edges`` are the linking ones of eligible documents, ``clusters`` as graph.clusters gives them."""
    if not 0 <= severity <= 5 or repeats < 2 or burst < 2:
        raise ValueError("thresholds: severity from 0 to 5, repeats and burst from 2")
    severe = _rows(docs.filter(F.col("severity") >= severity), "high_severity", _short_hash(F.col("document_id")), F.col("severity"), severity, F.lit(1))
    keys = edges.groupBy("key").agg(F.countDistinct("document_id").alias("n")).filter(F.col("n") >= repeats)
    repeated = _rows(keys, "repeated_indicator", _short_hash(F.col("key")), F.col("n"), repeats, F.col("n"), key=F.col("key"))
    return severe.unionByName(repeated).unionByName(bursts(clusters, burst))


def bursts(clusters: DataFrame, burst: int = fixed.BURST_SIZE) -> DataFrame:
    """Large clusters, named by their campaign: a document that joins one does not rename its anomaly."""
    large = clusters.filter(F.col("document_count") >= burst)
    return _rows(large, "burst_size", F.col("campaign_key"), F.col("document_count"), burst, F.col("document_count"), F.col("campaign_key"))


def evidence(anomalies: DataFrame, docs: DataFrame, every_edge: DataFrame, edges: DataFrame, keys: DataFrame, members: DataFrame) -> DataFrame:
    """anomaly_key, document_id, indicator_key: the documents and the indicators behind each anomaly, one of them a row.

    A severe document with all its indicators (``every_edge``), a repeated indicator with all its
    documents (``edges``), a large cluster with all its documents and shared indicators (``keys`` and ``members`` as graph.clusters gives them).
    """
    none = F.lit(None).cast("string")
    of = lambda kind, *columns: anomalies.filter(F.col("anomaly_type") == kind).select("anomaly_key", *columns)
    document = lambda df: df.select("anomaly_key", "document_id", none.alias("indicator_key"))
    indicator = lambda df: df.select("anomaly_key", none.alias("document_id"), F.col("key").alias("indicator_key"))
    named = docs.select("document_id", F.concat(F.lit("high_severity_"), _short_hash(F.col("document_id"))).alias("anomaly_key"))
    severe = of("high_severity").join(named, "anomaly_key")
    repeated = of("repeated_indicator", F.col("indicator_key").alias("key"))
    large = of("burst_size", "campaign_key")
    shared = keys.filter("n > 1").select("campaign_key", "key")
    parts = [
        document(severe),
        indicator(severe.join(every_edge.select("document_id", "key"), "document_id")),
        document(repeated.join(edges.select("document_id", "key"), "key")),
        indicator(repeated),
        document(large.join(members.select("campaign_key", "document_id"), "campaign_key")),
        indicator(large.join(shared, "campaign_key")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


#: Values of a list that are compared at once, before the rest of it is.
FIRST_VALUES = 8


def _list_ranks(rows: DataFrame, value: str, first: int = FIRST_VALUES) -> DataFrame:
    """anomaly_key, first, rank: the order of (first, rank) is that of each anomaly's ascending list of ``value``, compared as lists are, equal ones alike.

    ``first`` has a list's first values.  Where other lists have the same ones and more, the rest decides, by prefix doubling: values become numbers, then
    every place of a list gets the rank of the run of 1, 2, 4, ... values that begins there.  A list leaves once no other begins like it, or all
    of it is compared.  No list is ever one row; rounds grow with the logarithm of the longest common beginning.
    """
    have = rows.filter(F.col(value).isNotNull()).select("anomaly_key", value).distinct()
    begun = best(have, ["anomaly_key"], F.asc(value), n=first + 1).groupBy("anomaly_key").agg(F.array_sort(F.collect_list(value)).alias("v"))
    heads = written(begun.select("anomaly_key", F.slice("v", 1, first).alias("first"), (F.size("v") > first).alias("more")), "heads")
    same = heads.groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more")).filter("n > 1 AND more").select("first")
    open_lists = written(heads.join(same, "first", "left_semi").select("anomaly_key"), "open")
    found, ranks = heads.select("anomaly_key", "first"), []
    if not open_lists.isEmpty():
        at = F.row_number().over(Window.partitionBy("anomaly_key").orderBy(value))
        left = have.join(open_lists, "anomaly_key", "left_semi")
        # values are numbered in order of their own: ranges of values by partition, and offsets of partitions
        runs = written(left.withColumn("at", at).join(_numbered(left.select(value).distinct(), value), value).select("anomaly_key", "at", F.col("number").alias("rank")), "runs")
        step = 1
        while True:
            longest = runs.groupBy("anomaly_key").agg(F.max("at").alias("n"))
            starts = runs.filter("at = 1").select("anomaly_key", "rank").join(longest, "anomaly_key")
            ranks.append(written(starts, f"rank-{step}"))
            alike = ranks[-1].groupBy("rank").agg(F.count(F.lit(1)).alias("_n"), F.max("n").alias("longest")).filter((F.col("_n") > 1) & (F.col("longest") > step)).select("rank")
            still = written(ranks[-1].join(alike, "rank", "left_semi").select("anomaly_key"), "open")
            if still.isEmpty():
                break
            kept = runs.join(still, "anomaly_key", "left_semi")
            later = kept.select("anomaly_key", (F.col("at") - step).alias("at"), F.col("rank").alias("then"))
            # a list that ends comes first
            pairs = written(kept.join(later, ["anomaly_key", "at"], "left").select("anomaly_key", "at", F.struct(F.col("rank"), F.coalesce("then", F.lit(0)).alias("then")).alias("pair")), "pairs")
            before, runs = runs, written(pairs.join(_numbered(pairs.select("pair").distinct(), "pair"), "pair").select("anomaly_key", "at", F.col("number").alias("rank")), "runs")
            discard(before, pairs)
            step *= 2
    # ranks of all rounds in order: a list that left early was alone, or equal to all that stood with it
    rank = F.array(*[F.coalesce(f"rank{k}", F.lit(0)) for k in range(len(ranks))]) if ranks else F.array().cast("array<bigint>")
    for k, of in enumerate(ranks):
        found = found.join(of.select("anomaly_key", F.col("rank").alias(f"rank{k}")), "anomaly_key", "left")
    return found.select("anomaly_key", "first", rank.cast("array<bigint>").alias("rank"))


def _numbered(values: DataFrame, column: str) -> DataFrame:
    """Rows of distinct values with their number (from 1) in ascending order: sorted in ranges, the ranges' sizes summed up."""
    parts = written(values.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # one row a partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return parts.withColumn("inside", inside).join(sizes, "part").select(*values.columns, (F.col("inside") + F.col("before")).alias("number"))


def ordered(anomalies: DataFrame, behind: DataFrame) -> DataFrame:
    """``anomalies`` with ``place`` (from 1): by kind, then by the whole sorted list of documents behind them, then by that of indicators, then by key."""
    behind = written(behind, "behind")
    lists = lambda value, name: _list_ranks(behind, value).select("anomaly_key", F.struct("first", "rank").alias(name))
    rows = anomalies.join(lists("document_id", "documents"), "anomaly_key", "left").join(lists("indicator_key", "indicators"), "anomaly_key", "left")
    # without any document or indicator: null, which comes first
    order = F.struct(F.array_position(F.lit(ORDER), F.col("anomaly_type")).alias("kind"), "documents", "indicators", "anomaly_key")
    rows = written(rows.withColumn("order", order).drop("documents", "indicators"), "ordered")
    return _numbered(rows, "order").drop("order").withColumnRenamed("number", "place")


def anomaly_rows(anomalies: DataFrame) -> DataFrame:
    """Rows to store: severity from 1 to 5, a reason in words, metrics, active."""
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    reason = F.concat(F.col("anomaly_type"), F.lit(": observed "), whole("observed"), F.lit(", threshold "), whole("threshold"))
    metrics = F.struct(F.col("observed").alias("observed_value"), "threshold", "document_count", "indicator_key")
    severity = F.greatest(F.lit(1), F.least(F.lit(5), F.bround("observed").cast("int")))
    return anomalies.select("anomaly_key", "anomaly_type", F.col("observed").alias("score"), severity.alias("severity"), reason.alias("reason"), metrics.alias("metrics"), "campaign_key", F.lit(True).alias("is_active"))
