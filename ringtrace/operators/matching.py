"""Bulk matching of submitted indicators against the registry, and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringtrace.functions import fixed
from ringtrace.operators.common import best


def met(submitted: DataFrame, links: DataFrame, campaigns: DataFrame, unique: bool = False) -> DataFrame:
    """input_id, campaign_key, key, role, contribution: a row for each exactly equal indicator.

    ``submitted``: input_id, kind, value (``unique`` if no row occurs twice); ``links``: campaign_key, key, role, weight; ``campaigns``: the
    registry, of which only active ones that are not dismissed count.  A role scales its weight.
    """
    keyed = submitted.select("input_id", F.concat_ws("|", "kind", "value").alias("key"))
    factor = F.lit(0.0)
    for role, f in fixed.ROLE_FACTORS.items():
        factor = F.when(F.col("role") == role, f).otherwise(factor)
    known = links.filter(F.col("role").isin(*fixed.ROLE_FACTORS)).withColumn("contribution", F.least(F.lit(1.0), F.col("weight") * factor))
    live = campaigns.filter("is_active AND status <> 'dismissed'").select("campaign_key")
    rows = (keyed if unique else keyed.distinct()).join(known.join(live, "campaign_key"), "key")
    return rows.select("input_id", "campaign_key", "key", "role", "contribution")


def exact(submitted: DataFrame, links: DataFrame, campaigns: DataFrame, unique: bool = False) -> DataFrame:
    """input_id, campaign_key, match_score, anchor_match, n_reasons, reasons: a noisy-or over exactly equal indicators, as :func:`met` finds them."""
    return met(submitted, links, campaigns, unique).groupBy("input_id", "campaign_key").agg(
        F.round(1 - F.product(1 - F.col("contribution")), 4).alias("match_score"),
        F.max(F.col("role") == "anchor").alias("anchor_match"),
        F.count(F.lit(1)).cast("int").alias("n_reasons"),
        F.array_sort(F.collect_list(F.struct("key", "role", F.round("contribution", 4).alias("contribution")))).alias("reasons"),
    )


def best_campaign(matches: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One campaign an input: anchor, score, confirmed, risk, documents, then key."""
    about = campaigns.select("campaign_key", "analyst_confirmed", "risk_score", "document_count")
    order = [F.desc(c) for c in ("anchor_match", "match_score", "analyst_confirmed", "risk_score", "document_count")]
    return best(matches.join(about, "campaign_key"), ["input_id"], *order, F.asc("campaign_key"))


def status(category: Column, specific: Column, anchor: Column, score: Column, confirmed: Column, contextual: Column) -> Column:
    """matched_campaign, possible_match, new_unmatched_case or not_scam."""
    concrete = F.coalesce(specific & category.isin(*fixed.ELIGIBLE_CATEGORIES), F.lit(False))
    s, a = F.coalesce(score, F.lit(0.0)), F.coalesce(anchor, F.lit(False))
    lookup = (category == "noise") & a
    return (
        F.when(~concrete & lookup & F.coalesce(confirmed, F.lit(False)), "matched_campaign")
        .when(~concrete & lookup, "possible_match")
        .when(~concrete, "not_scam")
        .when(F.coalesce(contextual, F.lit(False)), F.when(s >= fixed.CONTEXTUAL, "possible_match").otherwise("new_unmatched_case"))
        .when(a | (s >= fixed.MATCHED), "matched_campaign")
        .when(s >= fixed.POSSIBLE, "possible_match")
        .otherwise("new_unmatched_case")
    )


def first_candidate(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first candidate of each lookup that has eligible evidence (kind, value)."""
    there = candidates.join(evidence.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    return there.groupBy("lookup_id").agg(F.min_by(F.struct("kind", "value"), "rank").alias("c")).select("lookup_id", "c.kind", "c.value")


def campaign_evidence(members: DataFrame, docs: DataFrame, n: int = 8) -> DataFrame:
    """The best documents of each campaign, with a title where one is missing."""
    top = best(members, ["campaign_key"], F.desc("membership_score"), F.asc("document_id"), n=n)
    return top.join(docs.select("document_id", "title", "url"), "document_id", "left").select("campaign_key", "document_id", "membership_score", F.coalesce("title", F.lit("Untitled document")).alias("title"), "url")


def recommended(checks: DataFrame) -> DataFrame:
    """A row for each step (status, step, action) of each of ``checks`` (status, analyst_confirmed and more)."""
    confirmed = F.when(F.coalesce("analyst_confirmed", F.lit(False)), fixed.ACTIONS_BY_CONFIRMATION[True]).otherwise(fixed.ACTIONS_BY_CONFIRMATION[False])
    steps = F.array(*[F.lit(a) for a in fixed.OTHER_ACTIONS])
    for status, actions in fixed.ACTIONS.items():
        steps = F.when(F.col("status") == status, F.array(*[confirmed if a is None else F.lit(a) for a in actions])).otherwise(steps)
    return checks.select("*", F.posexplode(steps).alias("step", "action")).withColumn("step", F.col("step") + 1)
