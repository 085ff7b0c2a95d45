"""Views over the registry: masked lists and details, evidence cards, the relationship graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringtrace.functions import fixed, indicators, urls
from ringtrace.functions.text import let
from ringtrace.operators.common import best, sorted_set


def live(campaigns: DataFrame) -> DataFrame:
    return campaigns.filter("is_active AND status <> 'dismissed'")


def severity_band(severity: Column) -> Column:
    return F.when(severity >= 5, "critical").when(severity == 4, "high").when(severity == 3, "medium").otherwise("low")


def next_action(campaign: DataFrame) -> Column:
    """A struct of priority, title, reason and owner, by the campaign's confirmation, severity and risk."""
    action = lambda priority, title, reason, owner: F.struct(priority.alias("priority"), F.lit(title).alias("title"), F.concat(*reason).alias("reason"), F.lit(owner).alias("owner"))
    urgent, review = F.lit("URGENT"), F.lit("REVIEW")
    documents, keys = campaign["document_count"].cast("string"), campaign["indicator_count"].cast("string")
    unconfirmed = [documents, F.lit(" source documents and "), keys, F.lit(" exact indicators are linked, but an analyst has not confirmed this campaign yet.")]
    severe = [F.lit("The campaign is analyst-confirmed, reaches severity level "), campaign["maximum_severity"].cast("string"), F.lit(", and was last observed "), F.date_format(campaign["last_seen"], "yyyy-MM-dd HH:mm"), F.lit(".")]
    return (
        F.when(~F.coalesce(campaign["analyst_confirmed"], F.lit(False)), action(F.when(campaign["risk_score"] >= 5, urgent).otherwise(review), "Confirm the strongest campaign link", unconfirmed, "Fraud Analysis"))
        .when(campaign["maximum_severity"] >= 5, action(urgent, "Escalate this confirmed high-severity campaign", severe, "Fraud Operations"))
        .otherwise(action(review, "Review the newest linked evidence", [documents, F.lit(" source documents currently support this active campaign.")], "Fraud Analysis"))
    )


def registry(campaigns: DataFrame) -> DataFrame:
    """Live campaigns with masked keys, the anchor's kind, band and next action (order by risk, last seen, key to show)."""
    rows = live(campaigns)
    return rows.select(
        "campaign_key",
        indicators.key_kind(F.col("anchor")).alias("anchor_kind"),
        indicators.masked_key(F.col("anchor")).alias("masked_anchor"),
        "label",
        "status",
        F.round("risk_score", 4).alias("risk_score"),
        "document_count",
        severity_band(F.col("maximum_severity")).alias("band"),
        next_action(rows).alias("next_action"),
    )


def tactic_text(campaigns: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", F.array_join("scam_types", " "), F.array_join("bank_roles", " "), "label"))


def by_tactic(campaigns: DataFrame, pattern: str) -> DataFrame:
    """Campaigns whose labels match a bank's or tactic's pattern."""
    return campaigns.filter(F.regexp_replace(tactic_text(campaigns), "_", " ").rlike(pattern))


def top_indicators(roles: DataFrame, n: int = 24) -> DataFrame:
    """The first indicators of each campaign by role and weight, masked."""
    return best(roles, ["campaign_key"], F.asc("role"), F.desc("weight"), F.asc("key"), n=n).select("campaign_key", "role", F.round("weight", 4).alias("weight"), indicators.masked(indicators.key_kind(F.col("key")), indicators.key_value(F.col("key"))).alias("display_value"), "key")


def reason_labels(reasons: Column, n: int = 4) -> Column:
    """What may be shown of reasons (structs of reason_type and shared_document_count): the first ``n`` different labels."""

    def label(r: Column) -> Column:
        many = F.when(r["shared_document_count"] > 1, F.concat(F.lit("Exact indicator shared across "), r["shared_document_count"].cast("string"), F.lit(" sources"))).otherwise("Exact indicator shared across sources")
        return (
            F.when(r["reason_type"] == "shared_strong_indicator", many)
            .when(r["reason_type"] == "anchor_indicator", "Matches the campaign anchor indicator")
            .when(r["reason_type"] == "analyst_confirmation", "Relationship confirmed by an analyst")
            .otherwise("Linked by stored campaign evidence")
        )

    return F.slice(F.array_distinct(F.transform(F.coalesce(reasons, F.array().cast("array<struct<reason_type:string,shared_document_count:bigint>>")), label)), 1, n)


def member_reasons(reasons: DataFrame, n: int = 4) -> DataFrame:
    """campaign_key, document_id, labels of each member: what may be shown of its reasons (rows), the first ``n`` different labels by indicator."""
    one = F.struct("reason_type", "shared_document_count")
    label = F.get(reason_labels(F.array(one), 1), F.lit(0))
    each = reasons.select("campaign_key", "document_id", "indicator_key", label.alias("label")).groupBy("campaign_key", "document_id", "label").agg(F.min("indicator_key").alias("first"))
    top = best(each, ["campaign_key", "document_id"], F.asc("first"), F.asc("label"), n=n)
    # ``n`` rows a member at most
    rows = top.groupBy("campaign_key", "document_id").agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("l"))
    return rows.select("campaign_key", "document_id", F.transform("l", lambda x: x["label"]).alias("labels"))


def short_reasons(reasons: Column, n: int = 12, length: int = 180) -> Column:
    return F.slice(F.array_distinct(F.transform(reasons, lambda r: F.substring(r, 1, length))), 1, n)


def evidence_card(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """For each indicator: documents, sources, severity, confidence, categories, labels and when it was first seen."""
    about = docs.select("document_id", "category", F.col("confidence").alias("c"), "severity", "scam_types", "first_seen", "last_seen", "url")
    rows = edges.select("key", "document_id").distinct().join(about, "document_id")
    return rows.groupBy("key").agg(
        F.countDistinct("document_id").alias("document_count"),
        F.countDistinct("url").alias("source_count"),
        F.max("severity").alias("maximum_severity"),
        F.round(F.avg("c"), 4).alias("average_confidence"),
        sorted_set("category").alias("categories"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("scam_types")))), 1, 12).alias("scam_types"),
        F.min(F.least("first_seen", "last_seen")).alias("first_seen"),
    )


def newest_sources(edges: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    """The newest distinct addresses of each indicator."""
    rows = edges.select("key", "document_id").distinct().join(docs.select("document_id", "url", "last_seen"), "document_id")
    once = best(rows, ["key", "url"], F.desc("last_seen"), F.asc("document_id"))
    return best(once, ["key"], F.desc("last_seen"), F.asc("url"), n=n)


def best_cluster(matched: DataFrame, members: DataFrame, campaigns: DataFrame, unique: bool = False) -> DataFrame:
    """For each lookup's documents (lookup_id, document_id; ``unique`` if no row occurs twice) the campaign with most of them, then risk, then key."""
    shown = members.select("document_id", "campaign_key").join(live(campaigns).select("campaign_key", "risk_score"), "campaign_key")
    rows = matched.join(shown, "document_id")
    counts = rows.groupBy("lookup_id", "campaign_key", "risk_score").agg((F.count(F.lit(1)) if unique else F.countDistinct("document_id")).alias("matched"))
    return best(counts, ["lookup_id"], F.desc("matched"), F.desc("risk_score"), F.asc("campaign_key"))


def grounded_insights(insights: DataFrame, docs: DataFrame) -> DataFrame:
    """Given insights (title, body, evidence_ids, severity, confidence) with only known evidence; none left: dropped."""
    each = insights.select("title", "body", F.greatest(F.lit(1), F.least(F.lit(5), "severity")).alias("severity"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), F.explode("evidence_ids").alias("document_id"))
    known = each.join(docs.select("document_id", "url"), "document_id")
    out = known.groupBy("title", "body", "severity", "confidence").agg(sorted_set("document_id").alias("evidence_ids"), sorted_set(urls.public(F.col("url"))).alias("evidence_urls"))
    return out.withColumn("insight_key", F.sha2(F.concat_ws("|", "title", F.array_join("evidence_ids", ",")), 256))


def titled(label: Column) -> Column:
    """Every run of ASCII letters and digits with a capital first."""
    runs = F.regexp_extract_all(label, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))), "")


def taxonomy_entry(raw: Column, fallback: str) -> Column:
    """A struct of label and type (tactic or bank): known labels, then banks that a label names, then its words; null for a blank one."""
    entry = lambda label, kind: F.struct(label.alias("label"), F.lit(kind).alias("type"))

    def of(low: Column) -> Column:
        spaced = F.replace(low, F.lit("_"), F.lit(" "))
        out = None
        for name, (label, kind) in fixed.TAXONOMY.items():
            out = (F if out is None else out).when(low == name, entry(F.lit(label), kind))
        for part, label in fixed.BANKS.items():
            out = out.when(low.contains(part) | spaced.contains(part), entry(F.lit(label), "bank"))
        return out.when(F.trim(spaced) != "", entry(F.trim(titled(spaced)), fallback))

    return let(F.lower(F.coalesce(raw, F.lit(""))), of)


def id_part(value: Column) -> Column:
    """A label as part of an id: letters and digits with dashes, 80 characters; one without any gets a 32-bit hash of its characters."""
    low = F.lower(value)
    readable = F.left(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(80))
    hashed = F.aggregate(F.filter(F.split(low, ""), lambda c: c != ""), F.lit(2166136261), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(readable != "", readable).otherwise(F.concat(F.lit("tag-"), F.lower(F.hex(hashed))))


def node_type(kind: Column) -> Column:
    out = F.lit("indicator")
    for name, shown in fixed.NODE_TYPES.items():
        out = F.when(kind == name, shown).otherwise(out)
    return out


HUB = "registry-live-campaigns"


def graph(campaigns: DataFrame, roles: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, type, size, status; links: source, target, relation, status, weight) of the live registry.

    A hub, campaigns, three scam types and two bank roles of each, ``evidence`` (campaign_key, document_id, title, membership_score), and the
    first indicators.  Sizes and weights follow documents, scores and roles.  A node or link that occurs twice is kept once.
    """
    return _once(*_graph_parts(campaigns, roles, evidence))


def graph_of_tags(campaigns: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """:func:`filtered_graph` of :func:`graph`, for ``kind`` tactic or bank: campaigns, such tags, and the links of the two.

    Ids begin with the type of their node, so that nodes of other types cannot stand for these, and need not be built.
    """
    if kind.lower() not in ("tactic", "bank"):
        raise ValueError("kind must be tactic or bank")
    return filtered_graph(*_once(*_graph_parts(campaigns)), kind)


def _once(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    return best(nodes, ["id"], F.desc("size"), F.asc("label")), best(links, ["source", "target"], F.asc("relation"), F.desc("weight"))


def _graph_parts(campaigns: DataFrame, roles: DataFrame | None = None, evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links); without indicators and documents if ``roles`` and ``evidence`` are not given."""
    rows = live(campaigns).select("campaign_key", "label", "document_count", "scam_types", "bank_roles", "average_confidence", "analyst_confirmed")
    hub, campaign_id = F.lit(HUB), F.concat(F.lit("campaign-"), "campaign_key")
    sure = lambda fallback: F.when(F.col("analyst_confirmed"), "confirmed").otherwise(fallback)
    node = lambda df, i, label, kind, size, status: df.select(i.alias("id"), label.alias("label"), kind.alias("type"), size.cast("double").alias("size"), status.alias("status"))
    link = lambda df, a, b, relation, status, w: df.select(a.alias("source"), b.alias("target"), relation.alias("relation"), status.alias("status"), w.cast("double").alias("weight"))
    tags = F.concat(F.transform(F.slice("scam_types", 1, 3), lambda x: taxonomy_entry(x, "tactic")), F.transform(F.slice("bank_roles", 1, 2), lambda x: taxonomy_entry(x, "bank")))
    tagged = rows.select("campaign_key", "average_confidence", "analyst_confirmed", F.explode(tags).alias("tag")).filter("tag IS NOT NULL").withColumn("tag_id", F.concat_ws("-", "tag.type", id_part(F.col("tag.label"))))
    of = rows.select("campaign_key", "analyst_confirmed")
    relation = F.when(F.col("tag.type") == "bank", "BANK_ROLE").otherwise("SCAM_TYPE")
    nodes = [
        node(rows.agg(F.count(F.lit(1)).alias("n")).filter("n > 0"), hub, F.lit("Live campaign registry"), F.lit("registry"), F.lit(22), F.lit("live")),
        node(rows, campaign_id, F.col("label"), F.lit("campaign"), F.least(F.lit(24.0), 16 + F.sqrt(F.greatest(F.lit(1), "document_count"))), sure("provisional")),
        node(tagged, F.col("tag_id"), F.col("tag.label"), F.col("tag.type"), F.lit(11), F.lit(None).cast("string")),
    ]
    links = [
        link(rows, hub, campaign_id, F.lit("ACTIVE_CAMPAIGN"), F.lit("confirmed"), F.lit(0.62)),
        link(tagged, campaign_id, F.col("tag_id"), relation, sure("suggested"), F.greatest(F.lit(0.55), F.coalesce("average_confidence", F.lit(0.0)))),
    ]
    if evidence is not None:
        docs = evidence.join(of, "campaign_key").withColumn("doc_id", F.concat(F.lit("evidence-"), "document_id"))
        nodes.append(node(docs, F.col("doc_id"), F.col("title"), F.lit("evidence"), 11 + F.col("membership_score") * 4, F.lit("observed")))
        links.append(link(docs, campaign_id, F.col("doc_id"), F.lit("SOURCE_EVIDENCE"), F.lit("suggested"), F.col("membership_score")))
    if roles is not None:
        marks = top_indicators(roles).join(of, "campaign_key").withColumn("mark_id", F.concat(F.lit("indicator-"), F.sha2("key", 256)))
        size = F.when(F.col("role") == "anchor", 15).when(F.col("role") == "shared", 13).otherwise(10)
        nodes.append(node(marks, F.col("mark_id"), F.col("display_value"), node_type(indicators.key_kind(F.col("key"))), size, F.col("role")))
        links.append(link(marks, campaign_id, F.col("mark_id"), F.upper("role"), sure("suggested"), F.col("weight")))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, links)


def filtered_graph(nodes: DataFrame, links: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a type and all campaigns, and the links whose two ends are shown; ``ALL`` shows everything."""
    if kind.upper() == "ALL":
        return nodes, links
    shown = nodes.filter(F.col("type").isin("campaign", kind.lower()))
    ids = shown.select("id")
    both = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return shown, both


def neighbourhood(links: DataFrame, node: str) -> DataFrame:
    """Ids one link away from a node, and its own."""
    near = links.filter((F.col("source") == node) | (F.col("target") == node))
    return near.select(F.col("source").alias("id")).unionByName(near.select(F.col("target").alias("id"))).distinct()


def percent(score: Column) -> Column:
    """A share in whole percent, halves up; what is missing is 0."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0)))) * 100 + 0.5).cast("int")


def result_copy(status: Column, contextual: Column, confirmed: Column, score: Column) -> Column:
    """kicker, heading, context, match: what a check's result says first."""
    told = lambda copy: F.struct(*[F.lit(x).alias(n) for x, n in zip(copy, ("kicker", "heading", "context", "match"))])
    scored = lambda copy: F.struct(*[F.lit(x).alias(n) for x, n in zip(copy[:3], ("kicker", "heading", "context"))], F.concat(percent(score).cast("string"), F.lit(copy[3])).alias("match"))
    by_context, sure = F.coalesce(contextual, F.lit(False)), F.coalesce(confirmed, F.lit(False))
    return (
        F.when((status == "matched_campaign") & sure & ~by_context, told(fixed.CONFIRMED_COPY))
        .when(by_context, scored(fixed.CONTEXTUAL_COPY))
        .when(status.isin("matched_campaign", "possible_match"), scored(fixed.POSSIBLE_COPY))
        .when(status == "new_unmatched_case", told(fixed.NEW_COPY))
        .otherwise(told(fixed.OTHER_COPY))
    )


def impact_rows(checks: DataFrame) -> DataFrame:
    """input_id, place, value, label: five rows a check, of its campaign (campaign_key and the registry's columns) or, without one, of itself
    (status, category, severity, confidence, eligible_count)."""
    row = lambda value, label: F.struct(value.cast("string").alias("value"), (F.lit(label) if isinstance(label, str) else label).alias("label"))
    fifth = lambda c: F.concat(F.coalesce(c, F.lit(0)).cast("string"), F.lit("/5"))
    seen = F.coalesce(F.upper(F.date_format("first_seen", "dd MMM yyyy")), F.lit("NOT RECORDED"))
    of_campaign = [row(F.coalesce("document_count", F.lit(0)), "CAMPAIGN DOCUMENTS"), row(F.coalesce("indicator_count", F.lit(0)), "TOTAL CAMPAIGN SIGNALS"), row(fifth(F.col("maximum_severity")), "MAX SEVERITY"), row(F.format_string("%.1f", F.coalesce("risk_score", F.lit(0.0))), "RISK SCORE"), row(seen, "FIRST OBSERVED")]
    none = F.col("status") == "not_scam"
    of_case = [row(F.when(none, F.upper(F.replace("category", F.lit("_"), F.lit(" ")))).otherwise("NEW"), F.when(none, "CLASSIFICATION").otherwise("CASE STATUS")), row(fifth(F.col("severity")), "SEVERITY"), row(F.concat(percent(F.col("confidence")).cast("string"), F.lit("%")), "ANALYSIS CONF."), row(F.col("eligible_count"), "STRONG INDICATORS"), row(F.lit("NOW"), "ANALYZED")]
    each = F.when(F.col("campaign_key").isNotNull(), F.array(*of_campaign)).otherwise(F.array(*of_case))
    return checks.select("input_id", F.posexplode(each).alias("place", "r")).select("input_id", (F.col("place") + 1).alias("place"), "r.value", "r.label")


def result_view(checks: DataFrame, reasons: DataFrame, marks: DataFrame, n: int = 8) -> DataFrame:
    """input_id, place, title, value, share: the first ``n`` rows of evidence of each check.

    First the matched ``reasons`` (input_id, role, key, contribution) by contribution, then classification and severity of the check (category,
    specific_case, confidence, severity), then four of its eligible indicators ``marks`` (input_id, kind, value).
    """
    words = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    cut = lambda c: F.when(F.length(c) > 90, F.concat(F.left(c, F.lit(89)), F.lit("…"))).otherwise(c)
    row = lambda df, block, order, title, value, share: df.select("input_id", F.lit(block).alias("block"), order.cast("double").alias("order"), title.alias("title"), value.alias("value"), share.alias("share"))
    percents = lambda c: F.concat(percent(c).cast("string"), F.lit("%"))
    own = checks.select("input_id").distinct()
    first = best(marks.join(own, "input_id", "left_semi"), ["input_id"], F.asc("kind"), F.asc("value"), n=4)
    parts = [
        row(best(reasons, ["input_id"], F.desc("contribution"), F.asc("key"), n=n), 0, -F.col("contribution"), F.concat(F.upper("role"), F.lit(" MATCH")), cut(indicators.key_value(F.col("key"))), percents(F.col("contribution"))),
        row(checks, 1, F.lit(0), F.lit("CLASSIFICATION"), titled(words(F.col("category"))), percents(F.col("confidence"))),
        row(checks, 2, F.lit(0), F.lit("SEVERITY"), F.concat(F.col("severity").cast("string"), F.lit(" / 5")), F.concat(F.col("severity").cast("string"), F.lit("/5"))),
        row(first, 3, F.lit(0), F.upper(words(F.col("kind"))), cut(F.col("value")), F.lit("EXTRACTED")),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("input_id").orderBy("block", "order", "title", "value"))
    return rows.withColumn("place", place).filter(F.col("place") <= n).select("input_id", "place", "title", "value", "share")


def previews(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents as rows of a list: short text, indicators joined."""
    marks = edges.groupBy("document_id").agg(F.array_join(sorted_set("key"), ", ").alias("indicators"))
    return docs.join(marks, "document_id", "left").select("document_id", F.coalesce(F.substring("text", 1, 160), F.lit("")).alias("preview"), F.coalesce("indicators", F.lit("")).alias("indicators"))
