"""URL filters over time: captures against the list entries that were active when they were fetched.

A list is a table of dated entries (list_name, pattern, action, listed_at): from its date on an
entry holds for its pattern until the next entry of the same list and pattern.  Entries become
validity intervals; a capture has a handful of keys (its host, the host's parent domains, and the
host with the first path segment) and is joined by key to the one interval of each list that
contains its fetch time: an as-of join as an equi-join with a date range, so that neither side is
sorted by time and a busy host can be split by Spark's skew join.  All in DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Actions from the strongest to the weakest; ``clear`` ends an entry.
ACTIONS = ("allow", "block", "review")


def host_of(url: Column) -> Column:
    """Lower-case host without port, userinfo, leading ``www.`` and trailing dot; empty where there is none."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.$", "")


def path_head(url: Column) -> Column:
    """The first path segment, or empty."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*/([^/?#]+)", 1)


def keys_of(url: Column) -> Column:
    """The patterns that can name a capture, the most specific first: host/segment, host, parent domains of two labels or more."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    parents = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))).otherwise(F.array(host_of(url)))
    deep = F.when(path_head(url) != "", F.array(F.concat_ws("/", host_of(url), path_head(url)))).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.concat(deep, parents))


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, pattern, action, valid_from, valid_to (null: still valid) of dated entries.

    Of entries for one list and pattern at the same time the strongest action counts, and
    ``clear`` only if it is alone.  Entries without list, pattern or date are left out, and so are
    actions that are not known.
    """
    rank = F.coalesce(F.array_position(F.lit(list(ACTIONS)), F.col("action")), F.lit(0))
    known = entries.filter(F.col("list_name").isNotNull() & F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin(*ACTIONS, "clear"))
    first = F.min(F.struct(F.when(rank == 0, len(ACTIONS) + 1).otherwise(rank).alias("r"), "action"))["action"]
    dated = known.groupBy("list_name", F.lower("pattern").alias("pattern"), "listed_at").agg(first.alias("action"))
    after = Window.partitionBy("list_name", "pattern").orderBy("listed_at")
    return dated.withColumn("valid_to", F.lead("listed_at").over(after)).filter("action <> 'clear'").select("list_name", "pattern", "action", F.col("listed_at").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, fetched_at, host, verdict, pattern, list_name, valid_from of each of ``captures`` (key, url, fetched_at).

    The most specific pattern decides, then the strongest action (allow, block, review), then
    the list's name.  No active entry, a null URL or a null fetch time: verdict ``none``, the
    rest null.  ``key`` is taken to be unique; repeated rows are merged into one.
    """
    rows = captures.select(F.col(key).alias("k"), "url", "fetched_at").distinct()
    asked = rows.select("k", "url", "fetched_at", F.posexplode(keys_of(F.col("url"))).alias("depth", "pattern"))
    held = intervals(entries)
    active = asked.join(held, (asked["pattern"] == held["pattern"]) & (asked["fetched_at"] >= held["valid_from"]) & (asked["fetched_at"] < F.coalesce(held["valid_to"], F.lit("9999-12-31").cast("timestamp"))))
    order = F.struct("depth", F.array_position(F.lit(list(ACTIONS)), held["action"]).alias("strength"), "list_name", held["pattern"].alias("pattern"), held["action"].alias("action"), "valid_from")
    best = active.groupBy("k", "url", "fetched_at").agg(F.min(order).alias("best"))
    out = rows.join(best.select(F.col("k").alias("bk"), F.col("url").alias("bu"), F.col("fetched_at").alias("bf"), "best"), F.col("k").eqNullSafe(F.col("bk")) & F.col("url").eqNullSafe(F.col("bu")) & F.col("fetched_at").eqNullSafe(F.col("bf")), "left")
    return out.select(F.col("k").alias(key), "fetched_at", host_of(F.col("url")).alias("host"), F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.pattern").alias("pattern"), F.col("best.list_name").alias("list_name"), F.col("best.valid_from").alias("valid_from"))
