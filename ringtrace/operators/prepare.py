"""From labelled documents and raw indicators to the tables that the analytics read.

Documents: document_id, category, confidence, specific_case, severity, scam_types, bank_roles,
first_seen, last_seen.  Edges: document_id, kind, value, confidence, source, quote, position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringtrace.functions import fixed, indicators, text
from ringtrace.operators.common import best


def documents(raw: DataFrame) -> DataFrame:
    """Normal documents: unknown categories are noise, numbers are clamped, labels sorted and distinct."""
    category = text.kind(F.col("category"))
    return raw.select(
        text.collapse(F.col("document_id")).alias("document_id"),
        F.when(category.isin(*fixed.CATEGORIES), category).otherwise("noise").alias("category"),
        text.clamped(F.col("confidence"), 0, 1, 0).alias("confidence"),
        text.truthy(F.col("specific_case")).alias("specific_case"),
        text.clamped(F.col("severity"), 0, 5, 0).cast("int").alias("severity"),
        text.labels(F.col("scam_types")).alias("scam_types"),
        text.labels(F.col("bank_roles")).alias("bank_roles"),
        "first_seen",
        "last_seen",
    )


def classification(raw: DataFrame) -> DataFrame:
    """Documents labelled by a model: severity rounds half to even into 1 to 5; the rest as :func:`documents`."""
    severity = F.bround(F.col("severity").cast("string").try_cast("double"))
    return documents(raw.withColumn("severity", F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(severity, F.lit(1.0))))))


def edges(raw: DataFrame) -> DataFrame:
    """Normal edges, one for each document and indicator: of repeats the most confident, then the first.

    Unknown kinds and blank values are left out; a missing confidence is 1.
    """
    rows = raw.select(
        text.collapse(F.col("document_id")).alias("document_id"),
        text.kind(F.col("kind")).alias("kind"),
        text.collapse(F.col("value")).alias("display_value"),
        text.clamped(F.col("confidence"), 0, 1, 1).alias("confidence"),
        text.collapse(F.col("source")).alias("source"),
        text.collapse(F.col("quote")).alias("quote"),
        "position",
    )
    # each of these is computed once: what a column is made of is a column of the step before
    valued = rows.withColumn("value", indicators.collapsed_value(F.col("kind"), F.col("display_value")))
    keyed = valued.withColumns({"key": indicators.key(F.col("kind"), F.col("value")), "source": F.when(F.col("source") == "", "unknown").otherwise(F.col("source"))})
    first = best(keyed, ["document_id", "key"], F.desc("confidence"), F.asc("position"), F.asc("display_value"))
    # behind the window: a filter before it would be pushed below, and have the values computed twice
    out = first.filter(F.col("kind").isin(*fixed.KINDS) & (F.col("value") != ""))
    return out.select("document_id", "kind", "display_value", "value", "confidence", "source", "quote", "position", "key")


def eligible() -> Column:
    """Documents that campaigns are made of."""
    return F.col("category").isin(*fixed.ELIGIBLE_CATEGORIES) & (F.col("confidence") >= fixed.LEAST_CONFIDENCE) & F.col("specific_case")


def linking(edge_table: DataFrame) -> DataFrame:
    """Edges whose indicator may link documents."""
    return edge_table.filter(F.col("kind").isin(*fixed.LINK_WEIGHTS) & indicators.links(F.col("kind"), F.col("value")))


def analytics_input(docs: DataFrame, classes: DataFrame, doc_edges: DataFrame) -> DataFrame:
    """Classified documents with their edges nested in order; times fall back on each other; unclassified ones go."""
    nested = doc_edges.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("key", "kind", "value", "confidence", "source", "quote"))).alias("indicators"))
    first = F.coalesce("published_at", "first_seen")
    rows = docs.join(classes, "document_id").join(nested, "document_id", "left")
    return rows.withColumns({"first_seen": first, "last_seen": F.coalesce("last_seen", "published_at", "first_seen"), "indicators": F.coalesce("indicators", F.array().cast(nested.schema["indicators"].dataType))})


def checked_ids(docs: DataFrame) -> DataFrame:
    """``docs``, if every row has a document_id of its own; ValueError otherwise."""
    found = docs.groupBy(F.coalesce("document_id", F.lit("")).alias("document_id")).count().filter("`count` > 1 OR document_id = ''").limit(1).collect()
    if found:
        raise ValueError(f"missing or repeated document_id: {found[0].document_id!r}")
    return docs


def media_findings(media: DataFrame, findings: DataFrame, selected: DataFrame) -> DataFrame:
    """A document's media with a reviewer's findings for the selected addresses; what was not read is ``pending``."""
    wanted = findings.join(selected.select("document_id", "url").distinct(), ["document_id", "url"], "left_semi")
    renamed = wanted.select("document_id", "url", F.col("status").alias("new_status"), F.col("note").alias("new_note"))
    return media.join(renamed, ["document_id", "url"], "full").select("document_id", "url", F.coalesce("new_status", "status", F.lit("pending")).alias("status"), F.coalesce("new_note", "note").alias("note"))


def reconciled_fetch(asked: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """Every asked URL as fetched or failed, with the reason if one was given."""
    got = results.select("url_key", F.lit(True).alias("got")).distinct()
    why = errors.groupBy("url_key").agg(F.min("error").alias("error"))
    rows = asked.join(got, "url_key", "left").join(why, "url_key", "left")
    missing = F.col("got").isNull()
    return rows.select(*asked.columns, F.when(missing, "failed").otherwise("fetched").alias("status"), F.when(missing, F.coalesce("error", F.lit("no result"))).alias("error"))


def selection(docs: DataFrame, platforms: list[str] | None = None, statuses: list[str] | None = None, since=None, until=None, n: int | None = None) -> DataFrame:
    """Fetched documents to be labelled again, newest first."""
    out = docs.filter(F.col("fetched_at").isNotNull())
    out = out.filter(F.col("platform").isin(*platforms)) if platforms else out
    out = out.filter(F.col("status").isin(*statuses)) if statuses else out
    out = out.filter(F.col("published_at") >= since) if since is not None else out
    out = out.filter(F.col("published_at") <= until) if until is not None else out
    return out.orderBy(F.desc("published_at"), "document_id").limit(n) if n is not None else out
