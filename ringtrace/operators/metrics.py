"""Aggregate metrics, their evidence as rows beside them, and operational roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringtrace.operators.common import sorted_set


def summary(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, zeros for an empty input: documents, indicators, edges, mean confidence, highest severity."""
    d = docs.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.coalesce(F.round(F.avg("confidence"), 6), F.lit(0.0)).alias("average_confidence"),
        F.coalesce(F.max("severity"), F.lit(0)).alias("maximum_severity"),
    )
    e = edges.agg(F.countDistinct("key").alias("unique_indicator_count"), F.count(F.lit(1)).alias("document_indicator_edge_count"))
    return d.join(F.broadcast(e))  # one row each


def _by(docs: DataFrame, key: str) -> DataFrame:
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    groups = docs.groupBy(key).agg(F.count(F.lit(1)).alias("document_count"), F.round(F.avg("confidence"), 6).alias("average_confidence"), F.max("severity").alias("maximum_severity"))
    return groups.join(F.broadcast(total)).withColumn("document_share", F.round(F.col("document_count") / F.col("total"), 6)).drop("total")


def by_category(docs: DataFrame) -> DataFrame:
    return _by(docs, "category")


def by_severity(docs: DataFrame) -> DataFrame:
    return _by(docs, "severity").drop("maximum_severity")


def by_indicator(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """For each indicator: documents, categories, confidence, severity; shown as its last document has it."""
    rows = edges.join(docs.select("document_id", "category", F.col("confidence").alias("document_confidence"), "severity"), "document_id")
    return rows.groupBy("key", "kind").agg(
        F.countDistinct("document_id").alias("document_count"),
        sorted_set("category").alias("categories"),
        F.round(F.avg("document_confidence"), 6).alias("average_confidence"),
        F.max("severity").alias("maximum_severity"),
        F.max_by("display_value", "document_id").alias("display_value"),
    )


def evidence(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The documents behind each metric, a row each (metric_scope, metric_key, document_id): no row grows with the table."""
    row = lambda df, scope, key: df.select(F.lit(scope).alias("metric_scope"), key.cast("string").alias("metric_key"), "document_id")
    named = row(edges.join(docs.select("document_id"), "document_id", "left_semi"), "indicator", F.col("key"))
    return reduce(DataFrame.unionByName, [row(docs, "summary", F.lit("global")), row(docs, "category", F.col("category")), row(docs, "severity", F.col("severity")), named]).distinct()


def long_table(blocks: dict[str, tuple[DataFrame, str | None]], job_id: str, refreshed_at) -> DataFrame:
    """All blocks as rows (job_id, metric_scope, metric_key, metric_value as JSON, refreshed_at)."""
    rows = [df.select(F.lit(job_id).alias("job_id"), F.lit(scope).alias("metric_scope"), (F.col(key).cast("string") if key else F.lit("global")).alias("metric_key"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("metric_value"), F.lit(refreshed_at).alias("refreshed_at")) for scope, (df, key) in blocks.items()]
    return reduce(DataFrame.unionByName, rows)


def reconciled(metric_rows: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Snapshot cards of the newest summary: its documents, and whether the category and severity blocks of the same job and time add up to it."""
    newest = metric_rows.filter("metric_scope = 'summary'").agg(F.max_by(F.struct("job_id", "refreshed_at", "metric_value"), F.struct("refreshed_at", "job_id")).alias("s")).select("s.*")
    count = F.get_json_object("metric_value", "$.document_count").cast("bigint")
    same = metric_rows.join(F.broadcast(newest.select("job_id", "refreshed_at")), ["job_id", "refreshed_at"])
    sums = same.agg(F.sum(F.when(F.col("metric_scope") == "category", count)).alias("categories"), F.sum(F.when(F.col("metric_scope") == "severity", count)).alias("severities"))
    cards = campaigns.filter("is_active AND status <> 'dismissed'").agg(F.count(F.lit(1)).alias("active_campaigns"), F.count_if(F.col("risk_score") >= 5).alias("high_risk_campaigns"), F.coalesce(F.sum("document_count"), F.lit(0)).alias("evidence_documents"))
    out = newest.select(count.alias("document_count")).join(F.broadcast(sums)).join(F.broadcast(cards))
    agree = F.coalesce((F.col("categories") == F.col("document_count")) & (F.col("severities") == F.col("document_count")), F.col("document_count") == 0)
    return out.select("document_count", "active_campaigns", "high_risk_campaigns", "evidence_documents", agree.alias("reconciled"))


def job_counts(items: DataFrame) -> DataFrame:
    """For each job the items in each state, counted from the items themselves."""
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    return items.groupBy("job_id").agg(F.count(F.lit(1)).alias("discovered"), F.countDistinct("url_key").alias("deduplicated"), *map(state, ("fetched", "classified", "failed")))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and time by job, provider and operation."""
    return calls.groupBy("job_id", "provider", "operation").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("seconds"), 2).alias("seconds"))
