"""Similar messages by tokens and character trigrams: scores, and a join without caps.

Templates are dealt into blocks of bounded size, and a block is sent to all tasks: inputs are scanned once a block, and no row of them is
shuffled or written, only pairs that score are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringtrace.functions import text
from ringtrace.functions.text import let
from ringtrace.operators.common import best, discard, written

LEAST = 0.82
#: Characters of templates that are sent to all tasks at once; more of them go in blocks, with a scan of the inputs each.
BLOCK_CHARS = 4_000_000


def folded(c: Column) -> Column:
    return text.casefold(text.collapse(c))


def tokens(f: Column) -> Column:
    """Distinct runs of letters and digits of two characters or more, of a folded text."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(f, r"[^\p{L}\p{N}]+", " "), " "), lambda t: F.length(t) >= 2))


def trigrams(f: Column) -> Column:
    """Distinct runs of three characters; a text of fewer has none."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(f) - 2, F.lit(1))), lambda i: F.substr(f, i, F.lit(3)))
    return F.when(F.length(f) >= 3, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def score(a: Column, b: Column, a_tokens: Column, b_tokens: Column, a_grams: Column, b_grams: Column) -> Column:
    """1 for equal folded texts; up to 0.97 if one holds the other; else by tokens and trigrams, up to 0.99; or 0."""
    shorter = F.length(a) <= F.length(b)
    short, long = F.when(shorter, a).otherwise(b), F.when(shorter, b).otherwise(a)
    few = F.when(shorter, F.size(a_tokens)).otherwise(F.size(b_tokens))
    inside = (F.length(short) >= 24) & (few >= 4) & F.contains(long, short)
    met = F.size(F.array_intersect(a_tokens, b_tokens))
    containment = met / F.least(F.size(a_tokens), F.size(b_tokens))
    jaccard = met / (F.size(a_tokens) + F.size(b_tokens) - met)
    grams = F.size(a_grams) + F.size(b_grams)
    dice = F.when(grams > 0, 2 * F.size(F.array_intersect(a_grams, b_grams)) / grams).otherwise(0.0)
    weak = (met < 4) | (containment < 0.8) | (jaccard < 0.6) | (dice < 0.72)
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(inside, F.least(F.lit(0.97), 0.88 + F.length(short) / F.length(long) * 0.09))
        .when(weak, 0.0)
        .otherwise(F.least(F.lit(0.99), containment * 0.35 + jaccard * 0.25 + dice * 0.4))
    )


def _texts(df: DataFrame, key: str, column: str) -> DataFrame:
    """id, f (the folded text), t (distinct tokens), w (all words in order)."""
    f = df.select(F.col(key).alias("id"), folded(F.col(column)).alias("f"))
    words = F.filter(F.split(F.regexp_replace("f", r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return f.select("id", "f", words.alias("w")).select("id", "f", F.array_distinct(F.filter("w", lambda w: F.length(w) >= 2)).alias("t"), "w")


#: What a pair may meet by: a token of the template's prefix, the template's pair of words, the input's pair of words, the whole text.
TOKEN, TEMPLATE_PAIR, INPUT_PAIR, WHOLE = range(4)


def _probe(kind: int, *values: Column) -> Column:
    return F.xxhash64(F.lit(kind), *values)


def _pairs(kind: int) -> Column:
    """Probes of the neighbouring words of ``w``, in order."""
    return F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: _probe(kind, F.element_at("w", i), F.element_at("w", i + 1)))


def _inner(kind: int) -> Column:
    """Of those, the ones without the first and the last word, which may be cut off in a longer text."""
    return F.slice(_pairs(kind), 2, F.size("w") - 3)


def _needles(b: DataFrame) -> DataFrame:
    """template_id, probe, kind, size: what an input must have one of, to score with a template of ``b``.

    By tokens: the template's first tokens, rarest among templates first, that any text of a Jaccard similarity of 0.6 must share one
    of.  As the shorter text: its rarest pair of inner words.  As the longer one: all of its pairs.  Else its folded text.
    """
    each = b.filter("size(t) >= 4").select("id", F.explode("t").alias("token"))
    ranked = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("r"))
    size = F.size("r")
    first = F.slice("r", F.lit(1), size - F.ceil(size * 0.6).cast("int") + 1)
    tokens = ranked.select("id", F.explode(first).alias("x"), size.alias("size")).select("id", _probe(TOKEN, F.col("x.token")).alias("probe"), F.lit(TOKEN).alias("kind"), "size")
    long, none = b.filter("size(w) >= 4 AND length(f) >= 24"), F.lit(0).alias("size")
    inner = long.filter("size(t) >= 4").select("id", F.explode(F.array_distinct(_inner(TEMPLATE_PAIR))).alias("probe"))
    counts = long.select(F.explode(_pairs(TEMPLATE_PAIR)).alias("probe")).groupBy("probe").agg(F.count(F.lit(1)).alias("n"))
    rare = inner.join(counts, "probe").groupBy("id").agg(F.min(F.struct("n", "probe"))["probe"].alias("probe")).select("id", "probe", F.lit(TEMPLATE_PAIR).alias("kind"), none)
    around = long.select("id", F.explode(F.array_distinct(_pairs(INPUT_PAIR))).alias("probe"), F.lit(INPUT_PAIR).alias("kind"), none)
    whole = b.select("id", _probe(WHOLE, F.col("f")).alias("probe"), F.lit(WHOLE).alias("kind"), none)
    parts = tokens.unionByName(rare).unionByName(around).unionByName(whole)
    return parts.withColumnRenamed("id", "template_id")


def _probes() -> Column:
    """Of an input, all that a needle may equal; of its own inner pairs one is enough, as a longer text has all of them."""
    none = F.array().cast("array<bigint>")
    few, short = F.size("t") < 4, (F.size("w") < 4) | (F.length("f") < 24)
    tokens = F.when(few, none).otherwise(F.transform("t", lambda t: _probe(TOKEN, t)))
    pairs = F.when(short, none).otherwise(F.array_distinct(_pairs(TEMPLATE_PAIR)))
    own = F.when(short | few, none).otherwise(F.array(F.array_min(_inner(INPUT_PAIR))))
    return F.concat(tokens, pairs, own, F.array(_probe(WHOLE, F.col("f"))))


def _scored(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """input_id, template_id, similarity of all pairs of ``least`` or more; ``b`` is a block of templates that fits into memory.

    Nothing of ``a`` is shuffled: its probes meet the needles in place, and a pair goes on if it is what it met for.
    """
    # explode_outer, as the filter that comes with explode would compute the probes twice
    texts = b.select(F.col("id").alias("template_id"), F.col("f").alias("fb"), F.col("t").alias("tb"))
    needles = written(_needles(b), "needles")  # some of them a template's word
    met = a.select("id", "f", "t", F.explode_outer(_probes()).alias("probe")).join(F.broadcast(needles), "probe")
    near = (F.size("t") >= 0.6 * F.col("size")) & (F.col("size") >= 0.6 * F.size("t"))
    pairs = met.filter((F.col("kind") != TOKEN) | near).drop("probe", "size").join(F.broadcast(texts), "template_id")
    common, sizes = F.size(F.array_intersect("t", "tb")), F.size("t") + F.size("tb")
    by_tokens = let(common, lambda n: (n >= 4) & (n >= 0.6 * (sizes - n)))
    fit = F.when(F.col("kind") == TOKEN, by_tokens).when(F.col("kind") == TEMPLATE_PAIR, F.contains("f", F.col("fb"))).when(F.col("kind") == INPUT_PAIR, F.contains("fb", F.col("f"))).otherwise(F.col("f") == F.col("fb"))
    similarity = let(F.struct(trigrams(F.col("f")).alias("a"), trigrams(F.col("fb")).alias("b")), lambda g: score(F.col("f"), F.col("fb"), F.col("t"), F.col("tb"), g["a"], g["b"]))
    out = pairs.filter(fit).select(F.col("id").alias("input_id"), "template_id", similarity.alias("similarity")).filter(F.col("similarity") >= least)
    return out.groupBy("input_id", "template_id").agg(F.round(F.max("similarity"), 4).alias("similarity"))  # a pair may have met by several


def similar(inputs: DataFrame, templates: DataFrame, least: float = LEAST, n: int | None = 5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """input_id, template_id, similarity: each input's ``n`` best templates with a score of ``least`` or more.

    All templates are compared, a block of some ``block_chars`` characters at once; a block's pairs are written, and of more blocks only each input's
    best are kept.
    """
    a, b = _texts(inputs, "input_id", "text"), written(_texts(templates, "template_id", "text").filter("f <> ''"), "templates")  # and so no empty input meets any
    chars = b.agg(F.coalesce(F.sum(F.length("f")), F.lit(0)).alias("n")).first().n
    first = lambda df: best(df, ["input_id"], F.desc("similarity"), F.asc("template_id"), n=n) if n else df
    blocks, out = max(1, -(-chars // block_chars)), None
    for k in range(blocks):
        found = _scored(a, b.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k), least)
        before, out = out, first(found if out is None else out.unionByName(found))
        if blocks > 1:
            out = written(out, "similar")
            discard(*([before] if before is not None else []))
    return out
