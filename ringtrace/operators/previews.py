"""Documents, events, jobs and clusters as rows to be shown: the first field that is filled, short texts, joined indicators.

Fields that a table lacks count as empty; a null or blank field gives way to the next.  What has no value at all is a dash.
Extra columns are ignored, repeated rows are shown each, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringtrace.operators.common import best, sorted_set

DASH = "—"
#: What :func:`document_table` reads of a document.
FIELDS = ["document_id", "published_at", "created_at", "platform", "author", "author_name", "title", "body", "search_snippet", "primary_category", "confidence", "severity", "agent_enriched", "agent_enriched_at", "agent_run_id", "canonical_url", "source_url", "url"]


def short(c: Column, length: int = 160) -> Column:
    """A text without outer white space, of ``length`` characters at most, the last an ellipsis if it was cut; null is empty."""
    bare = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(bare) <= length, bare).otherwise(F.concat(F.left(bare, F.lit(length - 1)), F.lit("…")))


def shown_time(c: Column) -> Column:
    """An ISO time with a space and UTC spelt out."""
    return F.coalesce(F.replace(F.replace(F.nullif(c.cast("string"), F.lit("")), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(" UTC")), F.lit(DASH))


def filled(df: DataFrame, *names: str, default: str | None = None) -> Column:
    """The first of the columns that exists and is not blank, as text."""
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default).cast("string"))


def _number(df: DataFrame, *names: str, kind: str = "double") -> Column:
    return filled(df, *names).try_cast("double").cast(kind)


def document_table(docs: DataFrame, classes: DataFrame, edges: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each document (document_id and any of the fields below) with its class, indicators, media states and source.

    ``classes``: document_id, primary_category, confidence, severity, one row a document; ``edges``: document_id, kind, display_value, position;
    ``media``: document_id, vision_status.  Indicators are joined in their order and cut to 300 characters.
    """
    docs = docs.select(*[c for c in docs.columns if c in FIELDS])
    named = F.concat(F.when(F.col("kind") != "", F.concat("kind", F.lit(": "))).otherwise(""), "display_value")
    marks = edges.filter("display_value <> ''").select("document_id", "position", named.alias("mark"))
    # 101 marks with their commas are over 300 characters, so that no more of them can be seen
    first = best(marks, ["document_id"], F.asc("position"), F.asc("mark"), n=101)
    joined = first.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "mark"))), lambda x: x["mark"]), ", ").alias("_marks"))
    states = media.filter("vision_status <> ''").groupBy("document_id").agg(F.array_join(sorted_set("vision_status"), ", ").alias("_states"))
    told = classes.select("document_id", F.nullif(F.col("primary_category"), F.lit("")).alias("_category"), F.col("confidence").cast("double").alias("_confidence"), F.col("severity").cast("double").alias("_severity"))
    rows = docs.join(told, "document_id", "left").join(joined, "document_id", "left").join(states, "document_id", "left")
    return rows.select(
        "document_id",
        shown_time(filled(docs, "published_at", "created_at")).alias("captured"),
        filled(docs, "platform", default=DASH).alias("platform"),
        filled(docs, "author", "author_name", default=DASH).alias("author"),
        short(filled(docs, "title", "body", "search_snippet"), 180).alias("content"),
        F.coalesce("_category", filled(docs, "primary_category", default=DASH)).alias("category"),
        F.coalesce("_confidence", _number(docs, "confidence")).alias("confidence"),
        F.coalesce("_severity", _number(docs, "severity")).alias("severity"),
        F.coalesce(short(F.col("_marks"), 300), F.lit("")).alias("indicators"),
        F.when(filled(docs, "agent_enriched", "agent_enriched_at", "agent_run_id", default="false") != "false", "Yes").otherwise("No").alias("agent"),
        F.coalesce("_states", F.lit(DASH)).alias("vision"),
        filled(docs, "canonical_url", "source_url", "url", default="").alias("source"),
    ).withColumn("indicators", F.when(F.col("indicators") == "", DASH).otherwise(F.col("indicators")))


def event_table(events: DataFrame) -> DataFrame:
    """A row for each event: time, severity in upper case (INFO without one), stage, message and details cut short.

    Details that are no text are written as JSON.
    """
    for name in ("details", "metadata", "data"):
        if name in events.columns and events.schema[name].dataType.typeName() in ("struct", "map", "array"):
            events = events.withColumn(name, F.to_json(name))
    return events.select(
        shown_time(filled(events, "created_at", "timestamp")).alias("time"),
        F.upper(filled(events, "severity", "level", default="info")).alias("severity"),
        filled(events, "stage", default=DASH).alias("stage"),
        short(filled(events, "message", "event"), 400).alias("message"),
        short(filled(events, "details", "metadata", "data"), 500).alias("details"),
    )


def job_table(jobs: DataFrame) -> DataFrame:
    """A row for each job: name, mode, status, stage, its counts (0 where missing) and when it last moved."""
    count = lambda *names: F.coalesce(_number(jobs, *names, kind="bigint"), F.lit(0)).cast("bigint")
    return jobs.select(
        filled(jobs, "name", "job_name", default="Untitled").alias("job"),
        filled(jobs, "mode", default=DASH).alias("mode"),
        filled(jobs, "status", default=DASH).alias("status"),
        filled(jobs, "current_stage", "stage", default=DASH).alias("stage"),
        count("discovered_count").alias("discovered"),
        count("fetched_count").alias("fetched"),
        count("agent_count", "agent_used").alias("agent"),
        count("classified_count").alias("classified"),
        count("failed_count").alias("failed"),
        shown_time(filled(jobs, "updated_at", "last_heartbeat")).alias("updated"),
    )


def cluster_table(clusters: DataFrame) -> DataFrame:
    """A row for each cluster, as graph.clusters gives them; its shared indicators are counted here and listed by the table ``keys``."""
    return clusters.select(
        F.col("campaign_key").alias("cluster"),
        F.col("risk_score").alias("risk"),
        F.col("document_count").alias("documents"),
        "maximum_severity",
        F.col("shared_count").alias("shared_indicators"),
        F.array_join("scam_types", ", ").alias("scam_types"),
        shown_time(filled(clusters, "updated_at", "last_seen")).alias("updated"),
    )
