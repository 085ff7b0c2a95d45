"""Secret scans: three patterns, and character Markov models for what they miss.

Spans come from expressions alone: the pieces between matches (``split``) and the matches
(``regexp_extract_all``) of one pattern give every match's place by running sums of their
lengths.  Two first-order Markov models, of random strings and of ordinary identifiers, are
counted over labelled samples; a long run of key characters outside the other spans whose
log-likelihood ratio speaks for randomness is added as a span of kind ``markov``.  All steps take
time by the length of a text, however many matches it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringtrace.llm.quality import let

#: Kinds in their order, with pattern, least length, the group it holds for, and text that any match contains.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ("passw", "secret", "token", "api")),
    "access": (r"AKIA[A-Z0-9]+", 20, 0, ("akia",)),
    "hex": (r"[0-9a-f]{24,}", 24, 0, ()),
}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z0-9_-]{6,}"
#: Documents that the models are trained on at most (those of the smallest hash).
SAMPLE_DOCS = 1000
#: A candidate's mean log-likelihood ratio a character, and its sum, must exceed these.
LEAST_MEAN, LEAST_SUM = 0.4, 10.0
#: Pseudo-count of each pair of characters.
SMOOTHING = 0.5
SPAN = "struct<start:int,kind:int,end:int>"
#: Elements that one fold of a running total goes over: as a fold copies its array at each step, long arrays are
#: cut, so that time grows with their length; and characters of the pieces that a text is cut to.
FOLD, PIECE = 256, 1024


def _none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each of ``values`` (non-negative ints) the total of those before it, by ``join`` (a sum, or F.greatest)."""
    zero = F.lit(0).cast("int")

    def simple(x: Column) -> Column:
        step = lambda s, v: F.struct(join(s["t"], v).cast("int").alias("t"), F.concat(s["out"], F.array(s["t"])).alias("out"))
        return F.aggregate(x, F.struct(zero.alias("t"), _none("int").alias("out")), step, lambda s: s["out"])

    def total(x: Column) -> Column:
        return F.aggregate(x, zero, lambda s, v: join(s, v).cast("int"))

    def cut(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / FOLD).cast("int")), lambda k: F.slice(x, k * FOLD + 1, F.lit(FOLD)))

    def joined(parts: Column) -> Column:
        bases = lambda totals: simple(totals)
        return let(let(F.transform(parts, total), bases), lambda base: F.flatten(F.transform(parts, lambda x, k: F.transform(simple(x), lambda v: join(v, F.get(base, k)).cast("int")))))

    return let(values, lambda x: F.when(F.size(x) <= FOLD, simple(x)).otherwise(let(cut(x), joined)))


def _find(text: Column, pattern: str, kind: int, least: int, group: int) -> Column:
    """Spans of the matches whose group has ``least`` characters or more, each with its ``word``."""

    def placed(found: Column, held: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def spans(before: Column) -> Column:
            start = lambda i: (F.get(before, i) + F.length(F.get(gaps, i))).cast("int")
            every = F.transform(found, lambda m, i: F.struct(start(i).alias("start"), F.lit(kind).alias("kind"), (start(i) + F.length(m)).cast("int").alias("end"), m.alias("word"), F.length(F.get(held, i)).alias("held")))
            return F.filter(every, lambda s: s["held"] >= least)

        return let(running(steps), spans)

    every = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("held"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(every, lambda m: placed(m["found"], m["held"], m["gaps"]))).otherwise(_none("struct<start:int,kind:int,end:int,word:string,held:int>"))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _hinted(text: Column, hints: tuple[str, ...]) -> Column:
    """Whether a text has any of the lower-case ``hints`` in either case: far cheaper than a pattern."""

    def found(low: Column) -> Column:
        out = F.lit(False)
        for hint in hints:
            out = out | low.contains(hint)
        return out

    return let(F.lower(text), found)


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then kind."""
    found = []
    for kind, (pattern, least, group, hints) in enumerate(KINDS.values()):
        own = _plain(_find(text, pattern, kind, least, group))
        if hints:
            own = F.when(_hinted(text, hints), own).otherwise(_none())
        found.append(own)
    return F.array_sort(F.concat(*found))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of each pair of characters of the alphabet, row by row.

    Labelled samples: random strings are what the patterns found in the sampled documents, and
    digests of their ids in hex and base64 (so there are some in any corpus); ordinary ones are
    the identifiers outside all those spans.  The model has one number for each pair of characters.
    """
    picked = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(F.lit("secrets"), "doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_docs).select("doc_id").distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id", "left_semi").withColumn("spans", base_spans(F.col("text")))
    cut = F.transform("spans", lambda s: F.substr("text", s["start"] + 1, s["end"] - s["start"]))
    hidden = F.regexp_extract_all(masked(F.col("text"), F.col("spans"), " "), F.lit(IDENTIFIER), F.lit(0))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("doc_id").cast("string")), 256)
    random = F.concat(F.filter(F.transform(cut, lambda c: F.regexp_extract(c, r"([A-Za-z0-9+/_=-]+)$", 1)), lambda c: F.length(c) >= 16), F.array(digest, F.base64(F.unhex(digest))))
    rows = texts.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), random.alias("words")), F.struct(F.lit(0).alias("random"), hidden.alias("words")))).alias("s"))
    words = rows.select("s.random", F.explode("s.words").alias("word")).groupBy("random", "word").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.select("random", "n", F.explode(F.transform(F.sequence(F.lit(2), F.length("word")), lambda i: F.substr("word", i - 1, F.lit(2)))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()}  # a row for each pair of characters at most

    def log(random: int, a: str, b: str) -> float:
        whole = sum(counts.get((random, a + x), 0) for x in ALPHABET)
        return math.log((counts.get((random, a + b), 0) + SMOOTHING) / (whole + SMOOTHING * len(ALPHABET)))

    return [round(log(1, a, b) - log(0, a, b), 6) for a in ALPHABET for b in ALPHABET]


def markov_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """Runs of CANDIDATE that look random, in what is left of the text when base spans are blanked."""
    size = len(ALPHABET)

    def score(word: Column, numbers: Column) -> Column:
        def total(letters: Column) -> Column:
            at = lambda i: F.instr(F.lit(ALPHABET), F.get(letters, i)) - 1
            return F.aggregate(F.sequence(F.lit(1), F.size(letters) - 1), F.lit(0.0), lambda s, i: s + F.get(numbers, at(i - 1) * size + at(i)))

        return let(F.filter(F.split(word, ""), lambda c: c != ""), total)

    def chosen(spans: Column) -> Column:
        numbers = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
        return _plain(let(numbers, lambda n: F.filter(spans, lambda m: let(score(m["word"], n), lambda x: (x > LEAST_SUM) & (x > LEAST_MEAN * (m["end"] - m["start"]))))))

    def looked(rest: Column) -> Column:
        return F.when(rest.rlike(CANDIDATE), let(_find(rest, CANDIDATE, len(KINDS), 0, 0), chosen)).otherwise(_none())

    return F.when(text.rlike(CANDIDATE), let(masked(text, base, None), looked)).otherwise(_none())


def masked(text: Column, spans: Column, mark: str | None) -> Column:
    """``text`` with every span, or run of spans that overlap, replaced by ``mark``, or by as many blanks as it has characters.

    ``spans`` ascend by start.  The text is cut to pieces once, so that no span is looked for from the text's beginning.
    """

    def rebuilt(x: Column) -> Column:
        pieces, before = x["pieces"], x["before"]

        def part(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            held = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.when(end > start, F.substr(held, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))

        def replaced(s: Column, i: Column) -> Column:
            done = F.get(before, i)
            if mark is None:
                fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], done)))
            else:
                fill = F.when((s["start"] >= done) | (i == 0), F.lit(mark)).otherwise(F.lit(""))
            return F.concat(part(done, s["start"]), fill)

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(spans, replaced), ""), part(last, F.length(text)))

    parts = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), running(F.transform(spans, lambda s: s["end"]), F.greatest).alias("before"))
    return F.when(F.size(spans) == 0, text).otherwise(let(parts, rebuilt))


def scanned(docs: DataFrame, ratios: list[float], prefix: str = "") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (names after ``prefix``): arrays of start, kind number, end.

    Starts and ends are code points of the whole text, ends exclusive; a null text has no spans;
    repeated rows are scanned alike; an empty table gives an empty one.  Columns of ``docs`` with the new names are
    replaced, unless ``prefix`` keeps them apart.
    """
    text, b, a = F.coalesce("text", F.lit("")), f"{prefix}base_spans", f"{prefix}all_spans"
    both = let(base_spans(text), lambda base: F.struct(base.alias("base"), markov_spans(text, base, ratios).alias("more")))
    out = docs.withColumn(f"{prefix}spans", both)
    return out.withColumns({b: F.col(f"{prefix}spans.base"), a: F.array_sort(F.concat(F.col(f"{prefix}spans.base"), F.col(f"{prefix}spans.more")))}).drop(f"{prefix}spans")


def written_out(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.lit([*KINDS, "markov"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    number = [*KINDS, "markov"].index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("bigint")
