"""Quality rules at document and at host level, in DataFrame expressions alone.

Every document is measured once.  Hosts (here: sources) get the share of their documents that
fail any rule, shrunk towards the corpus by a beta prior, so that a host of few documents is not judged
by chance.  The prior is fitted to all hosts (method of moments): their failures vary by chance even where all hosts are
alike, so this binomial part is taken off first, hosts being weighted by their documents.  If nothing is left, hosts do
not differ and none is untrusted.  Else a host is untrusted if its shrunk rate lies above the prior's mean by more than ``spreads``
deviations of its own posterior (a beta distribution).  Host verdicts are joined back to documents: a document
that fails a base rule goes; one that fails only a further rule (symbols, repeated lines)
goes if its host is untrusted.  A document that breaks no rule always stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringtrace.llm.common import SPACE, written

WINDOW = 8
#: Deviations of the posterior by which an untrusted host's rate lies above the prior's mean.
SPREADS = 3.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of ``window`` words found twice or more in the same text.

    Runs are compared by a 64-bit hash; only texts in which two hashes meet are looked at closer.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
            step = lambda a, i: F.struct((a["n"] + window - F.greatest(F.lit(0), a["end"] - i)).cast("bigint").alias("n"), (i + window).cast("bigint").alias("end"))
            return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), start, step, lambda a: a["n"])

        return let(placed, spans)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    looked = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))
    return F.when(F.size(words) > window, looked).otherwise(F.lit(0).cast("bigint"))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a whole text (null: none)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words_of(whole), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    repeated = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return F.struct(counted.alias("c"), repeated.alias("l"), F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"))


def measured(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with its measures as columns; ``prefix`` keeps them from clashing with others."""
    m = f"{prefix}measures"
    out = docs.withColumn(m, measures(F.col("text")))
    names = {"n_words": "c", "word_chars": "c", "n_repeat_words": "c", "n_lines": "l", "n_dup_lines": "l"}
    columns = {f"{prefix}{k}": F.col(f"{m}.{v}.{k}") for k, v in names.items()} | {f"{prefix}n_symbols": F.col(f"{m}.n_symbols")}
    out = out.withColumns(columns).drop(m)
    n, p = (lambda k: F.col(f"{prefix}{k}")), prefix
    base = (n("n_words") < 20) | (100 * n("n_repeat_words") > 30 * n("n_words"))
    soft = (10 * n("n_symbols") > n("word_chars")) | (2 * n("n_dup_lines") > n("n_lines"))
    return out.withColumns({f"{p}base_failed": base, f"{p}soft_failed": soft})


def host_verdicts(rows: DataFrame, host: str = "source", prefix: str = "", spreads: float = SPREADS) -> DataFrame:
    """A row for each host (null is one): host, documents, failures, rate (shrunk), host_rejected.

    With k hosts of n documents (N in all), mean rate m and S = sum(n * (rate - m)^2), the hosts' own share of the variance is
    (S / (m (1 - m)) - (k - 1)) / (N - sum(n^2) / N - (k - 1)); the prior is worth 1 / share - 1 documents, one at least.
    One host, rates that vary no more than by chance, and rates that are all 0 or all 1 leave every host at the mean.
    """
    failed = F.col(f"{prefix}base_failed") | F.col(f"{prefix}soft_failed")
    hosts = rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("documents"), F.sum(failed.cast("bigint")).alias("failures"))
    n, f = F.col("documents").cast("double"), F.col("failures").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("all"), F.sum(n * n).alias("squares"), F.sum(f).alias("failed"), F.sum(f * f / n).alias("own"))
    m, k = F.col("failed") / F.col("all"), F.col("k") - 1
    # S in one pass: sum(n * rate^2) - N * m^2
    between, within = F.col("own") - F.col("all") * m * m, m * (1 - m)
    share = F.when(within > 0, F.try_divide(F.try_divide(between, within) - k, F.col("all") - F.col("squares") / F.col("all") - k))
    prior = sums.select(m.alias("m"), F.when(share > 0, F.greatest(F.lit(1.0), 1 / share - 1)).alias("strength"))
    # the prior is one row
    rate = F.when(F.col("strength").isNull(), F.col("m")).otherwise((f + F.col("m") * F.col("strength")) / (n + F.col("strength")))
    rated = hosts.join(F.broadcast(prior)).select("host", "documents", "failures", "m", "strength", rate.alias("rate"))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("documents") + F.col("strength") + 1))
    return rated.select("host", "documents", "failures", "rate", F.coalesce(F.col("rate") - F.col("m") > spreads * deviation, F.lit(False)).alias("host_rejected"))


def judged(docs: DataFrame, host: str = "source", prefix: str = "", spreads: float = SPREADS, keep_text: bool = True) -> DataFrame:
    """``docs`` (without its texts unless ``keep_text``) with measures, base_failed, soft_failed, host_rejected and kept (names after ``prefix``).

    Nulls: a null text has no words and fails; a null host is a host of its own.  Repeated
    rows are judged alike.  An empty table gives an empty one.  Columns of ``docs`` with the names of
    measures are replaced, unless ``prefix`` keeps them apart.  What ``docs`` has is written once with
    its measures, as both the hosts and the verdicts read it; hosts are written too, so that
    Spark knows their size and broadcasts them only below its threshold.
    """
    rows = measured(docs, prefix)
    rows = written(rows if keep_text else rows.drop("text"), "quality")
    hosts = written(host_verdicts(rows, host, prefix, spreads).select(F.col("host").alias(f"{prefix}host"), F.col("host_rejected").alias(f"{prefix}host_rejected")), "hosts")
    out = rows.join(hosts, F.col(host).eqNullSafe(F.col(f"{prefix}host")), "left").drop(f"{prefix}host")
    kept = ~F.col(f"{prefix}base_failed") & ~(F.col(f"{prefix}soft_failed") & F.col(f"{prefix}host_rejected"))
    return out.withColumn(f"{prefix}kept", kept)
