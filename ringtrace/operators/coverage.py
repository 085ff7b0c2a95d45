"""Time windows, coverage grids and the registry of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def months(ranges: DataFrame) -> DataFrame:
    """Calendar months of each (start, end) date range, clipped to it: month, window_start, window_end, and other columns."""
    month = F.explode(F.sequence(F.trunc("start", "MM"), F.col("end"), F.expr("INTERVAL 1 MONTH"))).alias("month")
    more = [c for c in ranges.columns if c not in ("start", "end")]
    rows = ranges.filter("start <= end").select("start", "end", month, *more)
    return rows.select("month", F.greatest("start", "month").alias("window_start"), F.least("end", F.last_day("month")).alias("window_end"), *more)


def weeks(windows: DataFrame) -> DataFrame:
    """Chunks of seven days from each window's start, the last one cut short; other columns stay."""
    start = F.explode(F.sequence("window_start", "window_end", F.expr("INTERVAL 7 DAYS"))).alias("week_start")
    more = [c for c in windows.columns if c not in ("month", "window_start", "window_end")]
    return windows.select("month", "window_end", start, *more).select("month", "week_start", F.least("window_end", F.date_add("week_start", 6)).alias("week_end"), *more)


def week_counts(ranges: DataFrame) -> DataFrame:
    """month, n_weeks, days over all (start, end) ranges: equal ranges are cut once and weighted by their number."""
    out = weeks(months(ranges.groupBy("start", "end").agg(F.count(F.lit(1)).alias("n"))))
    return out.groupBy("month").agg(F.sum("n").alias("n_weeks"), F.sum(F.col("n") * (F.datediff("week_end", "week_start") + 1)).alias("days"))


def gaps(seen: DataFrame, group: str, member: str, day: str, groups: DataFrame, members: list, first, last) -> DataFrame:
    """group, member, gap_start, gap_end: runs of days from ``first`` to ``last`` that no row of ``seen`` covers, for each of ``groups`` and ``members``.

    Within a pair that was seen, gaps lie between one seen day and the next; a pair that was not is one gap.  No grid of cells is made:
    members that a group lacks are the difference of two sets.  ``members`` are few (a column of a report); days beyond the bounds do not count.
    """
    within = seen.filter(F.col(day).between(F.lit(first), F.lit(last)) & F.col(member).isin(*members)).select(group, member, F.col(day).alias("day")).distinct()
    order = Window.partitionBy(group, member).orderBy("day")
    after = F.lead("day", 1).over(order)
    before = within.withColumn("previous", F.lag("day", 1).over(order)).filter("previous IS NULL").select(group, member, F.lit(first).cast("date").alias("gap_start"), F.date_sub("day", 1).alias("gap_end"))
    between = within.withColumn("next", F.coalesce(after, F.date_add(F.lit(last).cast("date"), 1))).select(group, member, F.date_add("day", 1).alias("gap_start"), F.date_sub("next", 1).alias("gap_end"))
    known = within.groupBy(group).agg(F.collect_set(member).alias("known"))
    lacking = F.array_except(F.array(*map(F.lit, members)), F.coalesce("known", F.array().cast("array<string>")))
    never = groups.select(group).distinct().join(known, group, "left").select(group, F.explode(lacking).alias(member), F.lit(first).cast("date").alias("gap_start"), F.lit(last).cast("date").alias("gap_end"))
    return before.unionByName(between).unionByName(never).filter("gap_start <= gap_end")


def missing_cells(gap_rows: DataFrame, day: str = "day") -> DataFrame:
    """The days of each gap, a row each."""
    keys = [c for c in gap_rows.columns if c not in ("gap_start", "gap_end")]
    return gap_rows.select(*keys, F.explode(F.sequence("gap_start", "gap_end")).alias(day))


def drilled(events: DataFrame, cell: list[str], day: str, least: int = 10) -> DataFrame:
    """Counts by month, and by week for months that have ``least`` rows or more."""
    rows = events.withColumn("month", F.trunc(day, "MM").cast("date")).withColumn("week_start", F.date_add("month", (F.floor((F.dayofmonth(day) - 1) / 7) * 7).cast("int")))
    by_month = rows.groupBy(*cell, "month").agg(F.count(F.lit(1)).alias("n"))
    full = by_month.filter(F.col("n") >= least).select(*cell, "month")
    by_week = rows.join(full, [*cell, "month"], "left_semi").groupBy(*cell, "month", "week_start").agg(F.count(F.lit(1)).alias("n"))
    return by_month.withColumn("week_start", F.lit(None).cast("date")).unionByName(by_week)


def registered(registry: DataFrame, hits: DataFrame) -> DataFrame:
    """The registry of addresses after more hits: first seen stays, last seen moves on, hits are counted."""
    new = hits.groupBy("url_key").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count(F.lit(1)).alias("hits"))
    both = registry.select("url_key", "first_seen", "last_seen", "hits").unionByName(new)
    return both.groupBy("url_key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hits").alias("hits"))
