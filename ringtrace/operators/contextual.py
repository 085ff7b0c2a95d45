"""Campaigns that resemble a case without sharing an exact indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringtrace.functions import fixed
from ringtrace.operators.common import best, sorted_set, written

BRIDGE_WEIGHTS = {"account_identifier": 0.6, "organization_alias": 1.0, "payment_method": 0.2, "social_account": 0.8}


def label_tokens(label: Column) -> Column:
    return F.array_distinct(F.filter(F.split(label, "_"), lambda t: F.length(t) >= 2))


def label_similarity(left: Column, right: Column) -> Column:
    """The best match of any two labels: common tokens over those of the larger."""

    def pair(x: Column, y: Column) -> Column:
        a, b = label_tokens(x), label_tokens(y)
        return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.greatest(F.size(a), F.size(b)).cast("double")), F.lit(0.0))

    each = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: pair(x, y))))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def bridges(cases: DataFrame, links: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """case_id, campaign_key, bridge_kinds, bridge_score: contextual indicators that a case shares with
    documents of a campaign.  ``links``: case_id, kind, value; edges below a confidence of 0.6 do not count."""
    kinds = list(BRIDGE_WEIGHTS)
    weight = F.lit(0.0)
    for kind, w in BRIDGE_WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    asked = links.join(cases.select("case_id"), "case_id", "left_semi").filter(F.col("kind").isin(*kinds)).select("case_id", F.concat_ws("|", "kind", "value").alias("key"), "kind").distinct()
    known = edges.filter((F.col("confidence") >= 0.6) & F.col("kind").isin(*kinds)).select("key", "document_id")
    met = asked.join(known, "key").join(members.select("document_id", "campaign_key"), "document_id").select("case_id", "campaign_key", "kind").distinct()
    return met.groupBy("case_id", "campaign_key").agg(sorted_set("kind").alias("bridge_kinds"), F.round(F.least(F.lit(1.0), F.sum(weight)), 4).alias("bridge_score"))


def overlapping(cases: DataFrame, campaigns: DataFrame, by: str = "case_id") -> DataFrame:
    """case_id (or what ``by`` names), campaign_key of campaigns that share a token of a label: an equi-join on tokens."""
    spread = lambda df, key: df.select(key, F.explode(F.flatten(F.transform(F.concat("scam_types", "bank_roles"), label_tokens))).alias("token")).distinct()
    return spread(cases, by).join(spread(campaigns, "campaign_key"), "token").select(by, "campaign_key").distinct()


#: What of a case tells its score, but for bridges.
PROFILE = ["scam_types", "bank_roles", "kinds", "signals"]


def scored(rows: DataFrame, live: DataFrame) -> DataFrame:
    """``rows`` (PROFILE, campaign_key, bridge_kinds, bridge_score) with similarities and score; those without
    overlap need a similarity or a bridge."""
    of_campaign = live.select("campaign_key", F.col("scam_types").alias("c_types"), F.col("bank_roles").alias("c_roles"), "anchor", "average_confidence", "risk_score", "document_count", "analyst_confirmed", F.col("label").alias("c_label"))
    given = [c for c in rows.columns if c not in (*PROFILE, "bridge_kinds", "bridge_score")]
    rows = rows.join(of_campaign, "campaign_key")
    scam, bank = label_similarity(F.col("scam_types"), F.col("c_types")), label_similarity(F.col("bank_roles"), F.col("c_roles"))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))
    about = label_tokens(F.lower(F.concat_ws("_", F.regexp_replace(F.col("c_label"), r"[^\p{L}\p{N}]+", "_"), F.array_join("c_types", "_"), F.array_join("c_roles", "_"))))
    context = F.coalesce(F.array_max(F.transform("signals", lambda s: F.coalesce(F.try_divide(F.size(F.array_intersect(label_tokens(s), about)).cast("double"), F.size(label_tokens(s)).cast("double")), F.lit(0.0)))), F.lit(0.0))
    rows = rows.withColumns({"scam_similarity": scam, "bank_similarity": bank, "context_similarity": context, "scam_share": share(F.col("scam_types"), F.col("c_types")), "bank_share": share(F.col("bank_roles"), F.col("c_roles"))})
    kind = F.array_contains("kinds", F.element_at(F.split("anchor", "\\|"), 1)).cast("double")
    base = F.round(
        F.greatest("scam_share", "scam_similarity") * 0.55 + F.greatest("bank_share", "bank_similarity") * 0.05 + F.col("context_similarity") * 0.25
        + F.coalesce(kind, F.lit(0.0)) * 0.05 + F.least(F.lit(1.0), F.col("average_confidence")) * 0.05 + F.least(F.lit(1.0), F.col("risk_score") / 10) * 0.05, 4,
    )
    bridge = F.coalesce("bridge_score", F.lit(0.0))
    out = rows.withColumn("score", F.round(F.least(F.lit(1.0), base + bridge * 0.25), 4))
    keep = (F.col("scam_share") > 0) | (F.col("bank_share") > 0) | (F.col("scam_similarity") >= 0.34) | (F.col("bank_similarity") >= 0.5) | (F.col("context_similarity") >= 0.5) | F.col("bridge_kinds").isNotNull()
    similar = [F.round(c, 4).alias(c) for c in ("scam_similarity", "bank_similarity", "context_similarity")]
    return out.filter(keep).select(*given, "score", *similar, bridge.alias("bridge_score"), "analyst_confirmed", "risk_score", "document_count")


def ranked(rows: DataFrame, key: str, n: int) -> DataFrame:
    return best(rows, [key], F.desc("score"), F.desc("analyst_confirmed"), F.desc("risk_score"), F.desc("document_count"), F.asc("campaign_key"), n=n)


#: What of a campaign tells its part of the score, but for confidence and risk.
CLASS = ["scam_types", "bank_roles", "about", "anchor_kind"]
#: Scores are rounded to four places: what lies further below than this can't tie.
STEP = 2e-4


def _standing(c: DataFrame) -> Column:
    """What confidence and risk add to a campaign's score, whatever the case."""
    return F.least(F.lit(1.0), c["average_confidence"]) * 0.05 + F.least(F.lit(1.0), c["risk_score"] / 10) * 0.05


def classes(live: DataFrame, groups: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(classes: class and CLASS, with the most and the ``n``-th most standing; heads: class and campaign_key of those that can be among the ``n`` best).

    Campaigns that differ only in confidence, risk and words that no signal of ``groups`` has score alike but for their standing.  Of each
    class, those within a rounding step of the ``n``-th best standing stay, of equal standings the ``n`` that tie-breaks put first.
    """
    asked = groups.select(F.explode(F.flatten(F.transform("signals", label_tokens))).alias("token")).distinct()
    about = label_tokens(F.lower(F.concat_ws("_", F.regexp_replace(F.col("label"), r"[^\p{L}\p{N}]+", "_"), F.array_join("scam_types", "_"), F.array_join("bank_roles", "_"))))
    said = live.select("campaign_key", F.explode(about).alias("token")).join(asked, "token").groupBy("campaign_key").agg(sorted_set("token").alias("about"))
    rows = live.withColumn("standing", _standing(live)).join(said, "campaign_key", "left")
    rows = rows.withColumns({"about": F.coalesce("about", F.array().cast("array<string>")), "anchor_kind": F.element_at(F.split("anchor", "\\|"), 1), "scam_types": F.array_sort("scam_types"), "bank_roles": F.array_sort("bank_roles")})
    rows = rows.withColumn("class", F.sha2(F.to_json(F.struct(*CLASS)), 256)).select("class", *CLASS, "campaign_key", "standing", "analyst_confirmed", "risk_score", "document_count")
    heads = best(rows, ["class", "standing"], F.desc("analyst_confirmed"), F.desc("risk_score"), F.desc("document_count"), F.asc("campaign_key"), n=n)
    nth = best(heads, ["class"], F.desc("standing"), F.asc("campaign_key"), n=n).groupBy("class").agg(F.min("standing").alias("least"), F.max("standing").alias("most"), F.count(F.lit(1)).alias("held"))
    heads = written(heads.join(nth, "class").filter(F.col("standing") >= F.col("least") - STEP), "heads")
    kinds = heads.groupBy("class").agg(*[F.first(c).alias(c) for c in (*CLASS, "least", "most", "held")])
    return written(kinds, "classes"), heads.select("class", "campaign_key")


def _fit(rows: DataFrame) -> DataFrame:
    """Pairs of a profile and a class that resemble each other, with their ``score`` but for the standing."""
    scam, bank = label_similarity(F.col("scam_types"), F.col("c_types")), label_similarity(F.col("bank_roles"), F.col("c_roles"))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))
    context = F.coalesce(F.array_max(F.transform("signals", lambda s: F.coalesce(F.try_divide(F.size(F.array_intersect(label_tokens(s), F.col("about"))).cast("double"), F.size(label_tokens(s)).cast("double")), F.lit(0.0)))), F.lit(0.0))
    kind = F.coalesce(F.array_contains("kinds", F.col("anchor_kind")).cast("double"), F.lit(0.0))
    rows = rows.withColumns({"scam": scam, "bank": bank, "context": context, "scam_share": share("scam_types", "c_types"), "bank_share": share("bank_roles", "c_roles"), "kind": kind})
    rows = rows.filter((F.col("scam_share") > 0) | (F.col("bank_share") > 0) | (F.col("scam") >= 0.34) | (F.col("bank") >= 0.5) | (F.col("context") >= 0.5))
    return rows.withColumn("score", F.greatest("scam_share", "scam") * 0.55 + F.greatest("bank_share", "bank") * 0.05 + F.col("context") * 0.25 + F.col("kind") * 0.05)


def promising(groups: DataFrame, live: DataFrame, n: int) -> DataFrame:
    """profile, campaign_key of all campaigns that can be among a profile's ``n`` best by labels.

    Profiles meet classes of campaigns by the posting lists of label tokens.  A class bounds its campaigns from above by its own score and its
    most standing, and holds some down to its ``n``-th standing: classes are taken as long as their upper bound reaches the score that ``n`` campaigns have for certain.
    """
    kinds, heads = classes(live, groups, n)
    spread = lambda df, key: df.select(key, F.explode(F.flatten(F.transform(F.concat("scam_types", "bank_roles"), label_tokens))).alias("token")).distinct()
    met = spread(groups, "profile").join(spread(kinds, "class"), "token").select("profile", "class").distinct()
    of_class = kinds.select("class", F.col("scam_types").alias("c_types"), F.col("bank_roles").alias("c_roles"), "about", "anchor_kind", "least", "most", "held")
    rows = _fit(met.join(groups, "profile").join(of_class, "class"))
    rows = written(rows.select("profile", "class", "held", (F.col("score") + F.col("most")).alias("upper"), (F.col("score") + F.col("least")).alias("lower")), "met")
    certain = F.sum("held").over(Window.partitionBy("profile").orderBy(F.desc("lower"), "class"))
    known = rows.withColumn("certain", certain)
    kth = known.groupBy("profile").agg(F.max(F.when(F.col("certain") >= n, F.col("lower"))).alias("kth"))
    kept = rows.join(kth, "profile").filter(F.col("kth").isNull() | (F.col("upper") >= F.col("kth") - STEP))
    return kept.select("profile", "class").join(heads, "class").select("profile", "campaign_key")


def retrieved(cases: DataFrame, campaigns: DataFrame, bridged: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` best candidates of each case (case_id, scam_types, bank_roles, kinds, signals).

    Candidates share a label token or a bridge; the score weighs labels, signals, the anchor's kind, confidence
    and risk.  Equal profiles are searched once (:func:`promising`): a bridge only raises a score, so a case's
    best are among its profile's ``n`` best and its bridged ones.
    """
    live = written(campaigns.filter("is_active AND status <> 'dismissed' AND document_count > 0").select("campaign_key", "scam_types", "bank_roles", "anchor", "average_confidence", "risk_score", "document_count", "analyst_confirmed", "label"), "live")
    keyed = written(cases.select("case_id", *PROFILE).withColumn("profile", F.sha2(F.to_json(F.struct(*PROFILE)), 256)), "cases")
    groups = written(keyed.select("profile", *PROFILE).dropDuplicates(["profile"]), "profiles")
    pairs = promising(groups, live, n).join(groups, "profile")
    bare = pairs.withColumns({"bridge_kinds": F.lit(None).cast("array<string>"), "bridge_score": F.lit(0.0)})
    first = written(ranked(scored(bare, live), "profile", n), "profile-best")
    usual = keyed.select("case_id", "profile").join(first, "profile").drop("profile")
    bridged = written(bridged, "bridged")
    usual = usual.join(bridged.select("case_id", "campaign_key"), ["case_id", "campaign_key"], "left_anti")
    met = scored(bridged.join(keyed.drop("profile"), "case_id"), live)
    return ranked(usual.unionByName(met), "case_id", n).drop("analyst_confirmed", "risk_score", "document_count")


def profiles(candidates: DataFrame, members: DataFrame, docs: DataFrame, eligible: Column, n: int = 3) -> DataFrame:
    """The ``n`` best eligible documents of each candidate campaign."""
    fit = members.join(docs.filter(eligible), "document_id").join(candidates.select("campaign_key").distinct(), "campaign_key", "left_semi")
    top = best(fit, ["campaign_key"], F.desc("membership_score"), F.asc("document_id"), n=n)
    return top.groupBy("campaign_key").agg(F.array_sort(F.collect_list(F.struct("document_id", "membership_score", "category", "severity"))).alias("documents"))


def accepted(judgements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Judgements (made elsewhere) that count: likely related, a candidate of the case, sure enough, with two patterns
    and two dimensions, one of them beyond taxonomy."""
    shown = judgements.join(candidates.select("case_id", "campaign_key"), ["case_id", "campaign_key"], "left_semi")
    return shown.filter(
        (F.col("relationship") == "likely_related") & (F.col("confidence") >= fixed.CONTEXTUAL) & (F.size("shared_patterns") >= 2) & (F.size("matched_dimensions") >= 2)
        & (F.size(F.filter("matched_dimensions", lambda d: d != "taxonomy")) >= 1)
    )
