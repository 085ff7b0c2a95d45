"""Benchmark decontamination in DataFrame expressions alone.

The windows of all benchmark items are a broadcast hash set.  Every window of a document's words is
hashed and looked up there; a hit is verified word by word, so that equal hashes of different
words count for nothing.  Hits meet their document again by a key of its own, one row a hit, and
are folded to spans of words.  Spans can be cut out of the texts, or the documents left out.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringtrace.llm.common import written
from ringtrace.llm.quality import let

#: Words are runs of digits, ASCII letters and characters beyond ASCII; only A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same, before letters are lower-cased.
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW = 10
#: Bytes of windows that are broadcast at once; a larger benchmark is looked up in blocks.
BROADCAST_BYTES = 32 << 20

KEY = ["doc_id", "digest"]


def words_of(text: Column) -> Column:
    """The words of a whole text; null has none."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.octet_length(whole) == F.length(whole)
    low = F.when(plain, F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(low, BETWEEN + "+"), lambda w: w != "")


def run_hashes(words: Column, lengths: list[int]) -> Column:
    """For each length an array of hashes: of the run of so many words that begins at each word.

    Runs of 1, 2, 4, ... words come from pairs of halves, any other length from these.  A run that the end
    cuts short has a hash that means nothing.
    """
    top = max(lengths).bit_length() if lengths else 0

    def level(known: list[Column]) -> Column:
        size = 1 << len(known)
        if len(known) < top:
            half = known[-1]
            return let(F.transform(half, lambda h, i: F.xxhash64(h, F.get(half, i + size // 2))), lambda c: level([*known, c]))
        return F.array(*[joined(known, n) for n in lengths])

    def joined(known: list[Column], n: int) -> Column:
        parts = [k for k in reversed(range(n.bit_length())) if n >> k & 1]

        def one(h: Column, i: Column) -> Column:
            out, at = h, 1 << parts[0]
            for k in parts[1:]:
                out, at = F.xxhash64(out, F.get(known[k], i + at)), at + (1 << k)
            return out

        return F.transform(known[parts[0]], one)

    if not lengths:
        return F.array().cast("array<array<bigint>>")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: level([h]))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """h, window (its words), items: each distinct window with the ids of the items that have it.

    An item of fewer words is one window; one without words has none.  A null id is not listed, but its windows count.
    """
    rows = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))
    rows = rows.select("item_id", F.explode(each).alias("window"))
    lengths = sorted(r.n for r in rows.select(F.size("window").alias("n")).distinct().collect())  # ``window`` of them at most
    whole = F.lit(None).cast("bigint")
    for n in lengths:
        whole = F.when(F.size("window") == n, F.get(F.get(run_hashes(F.col("window"), [n]), F.lit(0)), F.lit(0))).otherwise(whole)
    return rows.groupBy("window").agg(F.collect_set("item_id").alias("items")).select(whole.alias("h"), "window", "items")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def hits(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each document (n_words) and each verified hit (start, end, items), keyed by id and digest of the text."""
    texts = docs.select("doc_id", digest(F.col("text")).alias("digest"), words_of(F.col("text")).alias("w"))
    # the first stands for the document itself
    hashes = F.concat(F.array(F.lit(None).cast("bigint")), F.flatten(run_hashes(F.col("w"), lengths)))
    # never empty; a plain posexplode would have Spark test that below, and compute all of it twice
    rows = texts.select(*KEY, "w", hashes.alias("hashes")).select(*KEY, "w", F.posexplode_outer("hashes").alias("at", "h"))
    rows = rows.join(F.broadcast(windows), "h", "left").withColumn("start", (F.col("at") - 1) % F.greatest(F.size("w"), F.lit(1)) + 1)
    rows = rows.filter((F.col("at") == 0) | (F.slice("w", F.col("start"), F.size("window")) == F.col("window")))
    span = F.when(F.col("at") > 0, F.struct((F.col("start") - 1).alias("start"), (F.col("start") - 1 + F.size("window")).alias("end")))
    return rows.select(*KEY, F.when(F.col("at") == 0, F.size("w").cast("bigint")).alias("n_words"), span.alias("span"), F.when(F.col("at") > 0, F.col("items")).alias("items"))


def merged_spans(spans: Column) -> Column:
    """Spans (start, end) of words joined where they touch or overlap, in order."""
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))))

    def islands(p: Column) -> Column:
        first = F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True)))
        last = F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True)))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))

    return let(places, islands)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, digest, n_words, n_hit, items, n_items, spans, contaminated: a row for each row of ``docs`` (doc_id, text).

    ``spans`` are the hit words (from 0, end exclusive), ``items`` the sorted ids of the items whose windows occur,
    ``digest`` tells texts of one id apart.  A null or empty text has no words and no hits; a null doc_id is a document
    like others; repeated rows are judged each, alike; an empty benchmark hits nothing; an empty table gives an
    empty one; texts may be of any length.  Other columns of both tables are not read, whatever their names.
    """
    docs = docs.select(F.col("doc_id"), F.col("text"))
    windows = written(item_windows(items.select("item_id", "text"), window), "windows")
    # at most one row for each length up to ``window``
    sizes = windows.groupBy(F.size("window").alias("n")).agg(F.sum(F.octet_length(F.array_join("window", "")) + 24 * F.size("window") + 16 * F.size("items")).alias("bytes")).collect()
    lengths, blocks = sorted(r.n for r in sizes), max(1, math.ceil(sum(r.bytes for r in sizes) / block_bytes))
    found = hits(docs, windows.filter(F.pmod("h", F.lit(blocks)) == 0) if blocks > 1 else windows, lengths)
    for block in range(1, blocks):  # each block of windows is a scan of its own
        more = hits(docs, windows.filter(F.pmod("h", F.lit(blocks)) == block), lengths)
        found = found.unionByName(more.filter(F.col("span").isNotNull()))
    # a group holds the hits of one text
    grouped = found.groupBy(*KEY).agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.collect_set("span").alias("hit"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    spans = grouped.withColumn("spans", merged_spans(F.col("hit"))).drop("hit")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    out = spans.select(*KEY, "n_words", n_hit.alias("n_hit"), ids.alias("items"), F.size("items").cast("bigint").alias("n_items"), "spans", "copies")
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def _cut(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` and what stands before each of them."""
    any_word = BETWEEN_ANY_CASE.replace("[", "[^", 1)
    units = F.regexp_extract_all(text, F.lit(f"{BETWEEN_ANY_CASE}*{any_word}+"), F.lit(0))
    tail = F.regexp_extract(text, f"({BETWEEN_ANY_CASE}*)$", 1)

    def rest(u: Column) -> Column:
        """Runs of units between one span and the next."""

        def run(k: Column) -> Column:
            start = F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))
            end = F.coalesce(F.get(spans, k)["start"], F.size(u))
            return F.array_join(F.slice(u, start + 1, end - start), "")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), run), "")

    return F.concat(let(units, rest), tail)


def cleaned(docs: DataFrame, found: DataFrame, spans_only: bool = True, prefix: str = "_dirty_") -> DataFrame:
    """``docs`` without contaminated documents, or (``spans_only``) with the hit words cut out of their texts.

    ``found`` is what :func:`contamination` gives for the same rows.  All columns stay as they are, but for text; columns
    of ``docs`` must not begin with ``prefix``.  Null and empty texts stay.
    """
    dirty = found.filter("contaminated").select(F.col("doc_id").alias(f"{prefix}id"), F.col("digest").alias(f"{prefix}digest"), F.col("spans").alias(f"{prefix}spans"))
    dirty = dirty.dropDuplicates([f"{prefix}id", f"{prefix}digest"])
    same = F.col("doc_id").eqNullSafe(F.col(f"{prefix}id")) & (digest(F.col("text")) == F.col(f"{prefix}digest"))
    if not spans_only:
        return docs.join(dirty, same, "left_anti")
    out = docs.join(dirty, same, "left")
    hit = F.col(f"{prefix}spans")
    return out.withColumn("text", F.when(hit.isNotNull(), _cut(F.col("text"), hit)).otherwise(F.col("text"))).select(*docs.columns)
