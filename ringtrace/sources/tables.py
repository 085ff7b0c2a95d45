"""Reading, writing and shaping of tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringtrace.functions import text, urls
from ringtrace.operators.common import best
from ringtrace.sources import store


def scan(df: DataFrame, columns: list[str], where: Column | None = None, order: list[Column] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Some columns of some rows; filters and columns reach the files."""
    out = df.filter(where) if where is not None else df
    out = out.orderBy(*order) if order else out
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out.select(*columns)


def full_read(df: DataFrame, order: list[Column], key: str) -> DataFrame:
    """All rows once, in an order that the key makes unique."""
    return best(df, [key], *order, F.asc(key)).orderBy(*order, F.asc(key))


def embedded(docs: DataFrame, classes: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Documents with their classification: all of them, or those of some categories."""
    chosen = classes.filter(F.col("category").isin(*categories)) if categories else classes
    return docs.join(chosen, "document_id", "inner" if categories else "left")


def nested(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with each child table as a sorted array of structs, empty where there are none."""
    out = parents
    for name, df in children.items():
        row = F.struct(*[c for c in df.columns if c != key])
        grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias(name))
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out


#: What a search provider returns.
RESULTS = "array<struct<position:int,title:string,snippet:string,link:string,source:string>>"


def search_results(responses: DataFrame, start: int = 0) -> DataFrame:
    """Rows of JSON responses (query_id, body): missing positions are counted, blank links left out, the site is the source or host."""
    rows = responses.select("query_id", F.posexplode(F.from_json(F.get_json_object("body", "$.organic_results"), RESULTS)).alias("i", "r"))
    link = F.trim(F.coalesce("r.link", F.lit("")))
    return rows.select("query_id", F.coalesce("r.position", F.col("i") + start + 1).cast("int").alias("position"), text.collapse(F.col("r.title")).alias("title"), link.alias("url"), F.coalesce("r.source", urls.domain(link)).alias("site")).filter("url <> ''")


def on_domains(results: DataFrame, domains: DataFrame) -> DataFrame:
    """Results on the wanted domains or below them: an equi-join of each distinct host and its parents."""
    rows = results.withColumn("_host", urls.domain(F.col("url")))
    parts = F.split("_host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    parents = rows.select("_host").distinct().filter(F.col("_host").isNotNull()).select("_host", F.explode(above).alias("domain"))
    hosts = parents.join(domains.select("domain"), "domain", "left_semi").select("_host").distinct()
    return rows.join(hosts, "_host", "left_semi").select(*results.columns)


def comments(docs: DataFrame) -> DataFrame:
    """Child rows of document_id, bodies: blank ones dropped, ids by place and digest."""
    rows = docs.select("document_id", F.posexplode("bodies").alias("position", "body")).withColumn("body", text.collapse(F.col("body"))).filter("body <> ''")
    return rows.withColumn("comment_id", F.concat_ws("-", F.col("position").cast("string"), F.substring(F.sha2("body", 256), 1, 16)))


def provenance(old: DataFrame, found: DataFrame) -> DataFrame:
    """Every (job, query, document) once, however often it was found; the first time stays."""
    keys = ["job_id", "query_id", "document_id"]
    return old.unionByName(found).groupBy(*keys).agg(F.min("found_at").alias("found_at"))


def append_log(rows: DataFrame, path: str, at: str = "at") -> None:
    """Add rows to a log that is partitioned by day."""
    rows.withColumn("dt", F.to_date(at)).write.mode("append").partitionBy("dt").parquet(path)


def recent(log: DataFrame, job_id: str | None = None, stage: str | None = None, level: str | None = None, n: int | None = None) -> DataFrame:
    """Newest events first, of a job, stage or level."""
    out = log
    for name, value in (("job_id", job_id), ("stage", stage), ("level", level)):
        out = out.filter(F.col(name) == value) if value is not None else out
    out = out.orderBy(F.desc("at"), F.desc("event_id"))
    return out.limit(n) if n is not None else out


def swap(df: DataFrame, root: str, spark: SparkSession) -> str:
    """Write a whole snapshot beside the others, then a pointer to it of the next number: no pointer is ever changed, so readers see one or the other."""
    path = f"{root}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store.put(spark, f"{root}/current/{max(_pointers(root, spark), default=-1) + 1:012d}.json", json.dumps({"path": path}))
    return path


def _pointers(root: str, spark: SparkSession) -> list[int]:
    return [int(n.removesuffix(".json")) for n in store.names(spark, f"{root}/current") if n.removesuffix(".json").isdigit()]


def current(root: str, spark: SparkSession) -> DataFrame:
    """The newest snapshot whose pointer is there."""
    newest = f"{root}/current/{max(_pointers(root, spark)):012d}.json"
    return spark.read.parquet(json.loads(spark.read.text(newest, wholetext=True).first().value)["path"])
