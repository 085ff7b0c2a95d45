"""Row rules that accept or reject, with the rules a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ringtrace.functions import fixed, urls
from ringtrace.operators.common import sorted_set


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks (a rule that is null is broken)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows; rejected ones have ``violations``."""
    checked = df.withColumn("violations", violations(rules))
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def observed(df: DataFrame, rules: dict[str, Column], observation: Observation) -> DataFrame:
    """``df`` as it is; whoever writes it finds rows and the breaches of each rule in ``observation``, without another scan."""
    broken = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *broken)


def enforced(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """``df`` as it is, if no row breaks a rule; else the job that reads it fails and names the row's ``key`` and its rules."""
    found = violations(rules)
    message = F.concat(F.lit("rules broken by "), F.coalesce(F.col(key).cast("string"), F.lit("a row without key")), F.lit(": "), F.array_join(found, ", "))
    return df.filter(F.when(F.size(found) == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """key, n of missing (as an empty text) and repeated keys: counts alone, whatever the rows."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(key)).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | (F.col(key) == ""))


def document_rules() -> dict[str, Column]:
    return {
        "category": F.col("category").isin(*fixed.CATEGORIES),
        "severity": F.col("severity").between(1, 5),
        "confidence": F.col("confidence").between(0, 1),
        "times": F.coalesce(F.col("first_seen") <= F.col("last_seen"), F.lit(True)),
    }


def campaign_rules() -> dict[str, Column]:
    return {
        "status": F.col("status").isin("provisional", "confirmed", "dismissed"),
        "confirmed": F.col("analyst_confirmed") | (F.col("status") != "confirmed"),
        "risk": F.col("risk_score").between(0, 10),
        "anchor": F.element_at(F.split("anchor", "\\|"), 1).isin(*fixed.LINK_WEIGHTS),
    }


def input_rules() -> dict[str, Column]:
    """Submitted checks: a text, address or image; lengths; a canonical address."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return {
        "something": has(F.col("text")) | has(F.col("url")) | F.col("image").isNotNull(),
        "text": F.coalesce(F.length("text") <= 8000, F.lit(True)),
        "url": ~has(F.col("url")) | ((F.length("url") <= 2048) & (urls.lookup_canonical(F.col("url")) != "")),
    }


def sound_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """campaign_key, sound: two members or more, each once, eligible categories, counts that add up, a linking anchor."""
    each = members.groupBy("campaign_key").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("document_id").alias("ids"))
    total = F.aggregate("category_counts", F.lit(0).cast("bigint"), lambda s, x: s + x["document_count"])
    fine = (F.col("rows") >= 2) & (F.col("rows") == F.col("ids")) & (total == F.col("document_count")) & F.forall("category_counts", lambda x: x["category"].isin(*fixed.ELIGIBLE_CATEGORIES)) & F.element_at(F.split("anchor", "\\|"), 1).isin(*fixed.LINK_WEIGHTS)
    return clusters.join(each, "campaign_key", "left").select("campaign_key", F.coalesce(fine, F.lit(False)).alias("sound"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), sorted_set(key).alias("keys")).filter("n > 1").drop("keys")
