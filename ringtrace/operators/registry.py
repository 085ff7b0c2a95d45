"""The campaign registry: snapshots merged by key, identities kept, analysts' edits preserved."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringtrace.functions import indicators
from ringtrace.operators.common import written
from ringtrace.operators.graph import components


def upsert(old: DataFrame, new: DataFrame, keys: list[str], protected: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` merged in by ``keys``: only columns that ``new`` has are overwritten.

    ``protected`` columns keep the old value where there is one.
    """
    supplied = [c for c in new.columns if c not in keys]
    right = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in supplied], F.lit(True).alias("_there"))
    rows = old.withColumn("_old", F.lit(True)).join(right, keys, "full")
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c in keys or c not in supplied:
            out.append(F.col(c))
        elif c not in old.columns:
            out.append(F.col(f"_new_{c}").alias(c))
        elif c in protected:
            out.append(F.coalesce(c, f"_new_{c}").alias(c))
        else:
            out.append(F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return rows.select(*out)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """``old`` with all children of the parents in ``new`` replaced by those."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def refreshed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A whole new snapshot: rows that it lacks stay as inactive, all of its own are active."""
    gone = old.join(new.select(key), key, "left_anti").withColumn("is_active", F.lit(False))
    return gone.unionByName(new.withColumn("is_active", F.lit(True)), allowMissingColumns=True)


def candidates(keys: DataFrame, old_keys: DataFrame) -> DataFrame:
    """campaign_key, old_key, overlap: old campaigns that share indicators with a new cluster.

    ``keys`` and ``old_keys`` (campaign_key, key) are the indicators of clusters and of the registry, a row each; a registry's anchors are among them.
    """
    known = old_keys.select(F.col("campaign_key").alias("old_key"), "key").distinct()
    return keys.select("campaign_key", "key").distinct().join(known, "key").groupBy("campaign_key", "old_key").agg(F.count(F.lit(1)).alias("overlap"))


#: Proposals of a connected group that one task settles; larger groups go through rounds first.
GROUP_PROPOSALS = 100_000


def _settled_in_rounds(pairs: DataFrame, largest: int) -> tuple[DataFrame | None, DataFrame]:
    """(settled, open): rounds that settle every cluster which no better-placed rival can disturb, until groups are small.

    A cluster keeps its first wish if no better-placed cluster lists that campaign at all.  The best-placed cluster of each group is always
    one of these, so a round settles one cluster a group at least.
    """
    settled = None
    while True:
        links = pairs.select(F.concat(F.lit("c:"), "campaign_key").alias("a"), F.concat(F.lit("o:"), "old_key").alias("b"))
        group = components(links).select(F.substring("document_id", 3, 1 << 30).alias("campaign_key"), F.col("component").alias("group"), F.left("document_id", F.lit(2)).alias("side")).filter("side = 'c:'")
        grouped = written(pairs.drop("group").join(group.drop("side"), "campaign_key"), "proposals")
        large = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > largest)
        if large.isEmpty():
            return settled, grouped
        crowded = grouped.join(large.select("group"), "group", "left_semi")
        first = crowded.groupBy("campaign_key").agg(F.min_by("old_key", "wish").alias("old_key"))
        ahead = crowded.groupBy("old_key").agg(F.min("place")["campaign_key"].alias("campaign_key"))
        kept = written(first.join(ahead, ["campaign_key", "old_key"]), "settled")
        settled = kept if settled is None else settled.unionByName(kept)
        rest = grouped.join(kept.select("campaign_key"), "campaign_key", "left_anti").join(kept.select("old_key"), "old_key", "left_anti")
        pairs = written(rest, "proposals")


def assigned(clusters: DataFrame, keys: DataFrame, old: DataFrame, old_keys: DataFrame, group_proposals: int = GROUP_PROPOSALS) -> DataFrame:
    """campaign_key, old_key: which old campaign each new cluster continues.

    Equal keys first.  Then clusters choose in order (most documents, then key) among old
    campaigns not yet taken and not dismissed: confirmed ones first, then the most common
    indicators, then the latest update.  Proposals fall into connected groups, which do not disturb each other; a group of at most
    ``group_proposals`` is settled by one task, choosing in order, so long chains of refusals cost no rounds.
    """
    exact = written(clusters.select("campaign_key").join(old.select("campaign_key"), "campaign_key").select("campaign_key", F.col("campaign_key").alias("old_key")), "exact")
    place = clusters.select("campaign_key", F.struct((-F.col("document_count")).alias("n"), "campaign_key").alias("place"))
    free_old = old.filter("status <> 'dismissed'").select(F.col("campaign_key").alias("old_key"), "analyst_confirmed", "updated_at")
    pairs = candidates(keys, old_keys).join(exact.select("campaign_key"), "campaign_key", "left_anti").join(exact.select("old_key"), "old_key", "left_anti")
    wish = F.row_number().over(Window.partitionBy("campaign_key").orderBy(F.desc("analyst_confirmed"), F.desc("overlap"), F.desc("updated_at"), "old_key"))
    pairs = written(pairs.join(free_old, "old_key").withColumn("wish", wish).join(place, "campaign_key").select("campaign_key", "old_key", "wish", "place"), "proposals")
    settled, rest = _settled_in_rounds(pairs, group_proposals)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out, done = set(), [], set()
        for row in rows.sort_values(["n", "campaign_key", "wish"]).itertuples():
            if row.campaign_key not in done and row.old_key not in taken:
                done.add(row.campaign_key)
                taken.add(row.old_key)
                out.append((row.campaign_key, row.old_key))
        return pd.DataFrame(out, columns=["campaign_key", "old_key"])

    chosen = rest.select("group", "campaign_key", "old_key", "wish", F.col("place.n").alias("n")).groupBy("group").applyInPandas(choose, "campaign_key string, old_key string")
    out = exact.unionByName(written(chosen, "chosen"))
    return out if settled is None else out.unionByName(settled)


def merged_keys(keys: DataFrame, old_keys: DataFrame, identities: DataFrame) -> DataFrame:
    """campaign_key, key of the new registry: a campaign that a cluster continues has that cluster's indicators, others keep their own."""
    named = keys.join(identities, "campaign_key", "left").select(F.coalesce("old_key", "campaign_key").alias("campaign_key"), "key").distinct()
    return replace_children(old_keys.select("campaign_key", "key"), named, "campaign_key")


def merged(clusters: DataFrame, old: DataFrame, identities: DataFrame) -> DataFrame:
    """The new registry: analysts' labels, status and confirmation are kept, blank labels are generated, dismissed
    campaigns stay inactive, and old ones that no cluster continues are inactive unless confirmed."""
    new = clusters.join(identities, "campaign_key", "left").select(
        F.coalesce("old_key", "campaign_key").alias("campaign_key"),
        F.col("anchor").alias("new_anchor"), F.col("document_count").alias("new_count"), F.col("risk_score").alias("new_risk"),
        indicators.campaign_label(F.get("scam_types", F.lit(0)), F.col("anchor")).alias("new_label"),
    )
    rows = old.join(new, "campaign_key", "full")
    found, status = F.col("new_anchor").isNotNull(), F.coalesce("status", F.lit("provisional"))
    confirmed = F.coalesce("analyst_confirmed", F.lit(False))
    return rows.select(
        "campaign_key",
        F.coalesce("new_anchor", "anchor").alias("anchor"),
        F.coalesce("new_count", "document_count").alias("document_count"),
        F.coalesce("new_risk", "risk_score").alias("risk_score"),
        F.when(F.trim(F.coalesce("label", F.lit(""))) == "", F.col("new_label")).otherwise(F.col("label")).alias("label"),
        status.alias("status"),
        confirmed.alias("analyst_confirmed"),
        ((status != "dismissed") & (found | confirmed)).alias("is_active"),
        "updated_at",
    )


def guarded(members: DataFrame, docs: DataFrame, eligible) -> DataFrame:
    """Members whose document is eligible."""
    return members.join(docs.filter(eligible).select("document_id"), "document_id", "left_semi")


def without_source(campaigns: DataFrame, clusters: DataFrame) -> DataFrame:
    """Active campaigns that no active cluster stands behind."""
    return campaigns.filter("is_active").join(clusters.select("campaign_key"), "campaign_key", "left_anti")


def resolved(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links with the id of their indicator, null where it is unknown."""
    return links.join(known.select("key", "indicator_id"), "key", "left")
