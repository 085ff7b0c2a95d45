"""Views of the driver's tables in the shape of campaign data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringtrace.functions import fixed, text, urls


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labelled cases."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    shipped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").join(shipped, orders["o_orderkey"] == shipped["l_orderkey"], "left")
    category = F.element_at(F.array(*[F.lit(c) for c in fixed.CATEGORIES]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return rows.select(
        F.col("o_orderkey").cast("string").alias("document_id"),
        category.alias("category"),
        ((F.col("o_orderkey") * 37 % 101) / 100.0).alias("confidence"),
        (F.col("o_orderkey") % 4 != 0).alias("specific_case"),
        (F.col("o_orderkey") % 6).cast("int").alias("severity"),
        F.array("o_orderpriority").alias("scam_types"),
        F.array("c_mktsegment").alias("bank_roles"),
        F.col("o_orderdate").alias("first_seen"),
        F.coalesce("shipped", "o_orderdate").alias("last_seen"),
    )


def case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items as the cases' indicators, of the eight linking kinds: a part in the week it was shipped (1992-01-01 where that is not known)."""
    items = read(spark, sf_dir, "lineitem")
    week = F.floor(F.coalesce(F.datediff("l_shipdate", F.lit("1992-01-01")), F.lit(0)) / 7)
    p = F.col("l_partkey").cast("bigint") * 1000 + week
    kinds = list(fixed.LINK_WEIGHTS)
    padded = F.lpad((p % 100_000_000).cast("string"), 8, "0")
    value = F.element_at(F.array(
        F.concat(F.lit("1000"), padded), F.concat(F.lit("+849"), padded), F.concat(F.lit("P"), p.cast("string"), F.lit("@shop.example")), F.concat(F.lit("www.p"), p.cast("string"), F.lit(".example.com")),
        F.concat(F.lit("@seller"), p.cast("string")), F.concat(F.lit("QRPAY "), p.cast("string")), F.concat(F.lit("ref-1"), padded), F.concat(F.lit("sha256:"), F.md5(p.cast("string"))),
    ), (p % 8 + 1).cast("int"))
    return items.select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (p % 8 + 1).cast("int")).alias("kind"),
        value.alias("value"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.lit("lineitem").alias("source"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("quote"),
        F.col("l_linenumber").alias("position"),
    )


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the hosts of their addresses."""
    host = urls.domain(F.col("url"))
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.concat(F.lit("domain|"), host).alias("key"))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with digests of their longer lines: some lines are in a tenth of all documents."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.length(F.trim("line")) >= 24).select("document_id", F.md5(F.trim("line")).alias("key")).distinct()


def line_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, edges) of all documents as cases, with their longer lines as indicators: hot ones, and large components."""
    i, day = F.col("doc_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")).cast("timestamp_ntz")
    category = F.element_at(F.array(*[F.lit(c) for c in fixed.CATEGORIES]), (i % 5 + 1).cast("int"))
    docs = read(spark, sf_dir, "documents").select(
        i.cast("string").alias("document_id"), category.alias("category"), ((i * 37 % 101) / 100.0).alias("confidence"), (i % 4 != 0).alias("specific_case"), (i % 6).cast("int").alias("severity"),
        F.array("lang").alias("scam_types"), F.array("source").alias("bank_roles"), day.alias("first_seen"), day.alias("last_seen"),
    )
    edges = line_edges(spark, sf_dir).select("document_id", F.lit("media_hash").alias("kind"), F.sha2("key", 256).alias("value"), F.lit(0.9).alias("confidence"), F.lit("document").alias("source"), F.lit("line").alias("quote"), F.lit(0).alias("position"))
    return docs, edges


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("input_id"), "text", "source")


def messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(inputs: lines of documents, templates: benchmark passages)."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    inputs = lines.filter(F.length("text") >= 12).select(F.concat_ws(":", "doc_id", "n").alias("input_id"), "text")
    return inputs, read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("template_id"), "text")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as crawl items: job by user, address by JSON key."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("at"), F.concat(F.lit("job-"), (F.col("user_id") % 20).cast("string")).alias("job_id"), F.concat(F.lit("u"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("-"))).alias("url_key"), "event_type", "value", text.kind(F.col("event_type")).alias("operation"))
