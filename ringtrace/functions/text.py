"""Text and number normalisation as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ringtrace.functions import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body).getItem(0)


def collapse(c: Column) -> Column:
    """Every run of Unicode white space as one space, none at the ends; null is empty.  ASCII without white space needs no pattern."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    for space in " \t\n\x0b\x0c\r":
        plain = plain & ~text.contains(space)
    return F.when(plain, text).otherwise(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def casefold(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def half_width(c: Column) -> Column:
    """Full-width forms of the ASCII characters as those, and the ideographic space as a space."""
    wide = "".join(chr(x + 0xFEE0) for x in range(0x21, 0x7F)) + "　"
    return F.when(c.rlike(r"[\x{FF01}-\x{FF5E}\x{3000}]"), F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")).otherwise(c)


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Compatibility forms beyond :func:`half_width`; an Arrow UDF, for columns that need it."""
    return c.str.normalize("NFKC")


def kind(c: Column) -> Column:
    """An indicator kind or label: lower case, other characters as one underscore, other names resolved."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    names = F.create_map(*[F.lit(x) for pair in fixed.KIND_ALIASES.items() for x in pair])
    return F.when(c.cast("string").isin(*fixed.KINDS), c.cast("string")).otherwise(let(plain, lambda p: F.coalesce(F.try_element_at(names, p), p)))


def labels(c: Column) -> Column:
    """A list of labels: each normalised, without blanks, distinct and sorted; null is none."""
    each = F.filter(F.transform(c, kind), lambda x: x != "")
    return F.coalesce(F.array_sort(F.array_distinct(each)), F.array().cast("array<string>"))


def taxonomy_labels(c: Column) -> Column:
    """Labels of lookups: any letters and digits, others as one underscore, 80 characters, distinct."""
    plain = lambda x: F.substring(F.regexp_replace(F.regexp_replace(casefold(half_width(x)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""), 1, 80)
    return F.coalesce(F.array_distinct(F.filter(F.transform(c, plain), lambda x: x != "")), F.array().cast("array<string>"))


def phone(c: Column) -> Column:
    """Digits, with the country prefix 84 as a leading zero, or a kept plus."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    home = digits.startswith("84") & (F.length(digits) >= 10)
    return F.when(digits == "", "").when(home, F.concat(F.lit("0"), F.substr(digits, F.lit(3)))).when(F.ltrim(c).startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def code(c: Column) -> Column:
    """Account numbers and references: letters and digits alone, in upper case."""
    return F.upper(F.regexp_replace(half_width(c), "[^A-Za-z0-9]", ""))


def money(c: Column) -> Column:
    """An amount as a plain decimal and its currency, if any; no number: the text in upper case."""
    text = F.trim(half_width(c))
    low = F.lower(text)
    currency = F.when(low.rlike("vnd|vnđ|₫|đồng|đ$"), " VND").when(low.rlike(r"\$|usd"), " USD").when(low.rlike("eur|€"), " EUR").otherwise("")
    number = F.regexp_replace(F.regexp_extract(text, r"[-+]?\d[\d.,\s]*", 0), r"\s+", "")

    def amount(n: Column) -> Column:
        groups = F.split(n, "[.,]")
        thousands = (F.size(groups) > 1) & F.forall(F.slice(groups, 2, F.size(groups)), lambda g: (g == "") | (F.length(g) == 3))
        point = F.when(thousands, F.array_join(groups, "")).when(n.contains(",") & ~n.contains("."), F.replace(n, F.lit(","), F.lit("."))).when(
            n.contains(",") & n.contains("."), F.concat(F.regexp_replace(F.regexp_extract(n, "^(.*)[.,]([^.,]*)$", 1), "[.,]", ""), F.lit("."), F.regexp_extract(n, "^(.*)[.,]([^.,]*)$", 2))
        ).otherwise(n)
        decimal = point.try_cast("decimal(38,10)").cast("string")
        plain = F.regexp_replace(F.regexp_replace(decimal, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        return F.coalesce(plain, F.regexp_replace(n, "[^0-9+-]", ""))

    return F.when(F.regexp_extract(text, r"\d", 0) == "", F.upper(collapse(text))).otherwise(F.trim(F.concat(let(number, amount), currency)))


def clamped(c: Column, low: float, high: float, default: float) -> Column:
    """A number within bounds: what lies beyond is moved to the bound; what is no number is ``default``."""
    number = c.cast("string").try_cast("double")
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(number, F.lit(float(default)))))


def within(c: Column, low: float, high: float, default: float | None) -> Column:
    """A number within bounds, else ``default``."""
    number = c.cast("string").try_cast("double")
    return F.when(number.between(low, high), number).otherwise(F.lit(default).cast("double"))


def truthy(c: Column) -> Column:
    return F.coalesce(casefold(F.trim(c.cast("string"))).isin("1", "1.0", "true", "yes", "y", "có", "co"), F.lit(False))


def timestamp(c: Column) -> Column:
    """ISO timestamps or their date alone, in UTC; anything else is null."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.try_cast("timestamp"), F.substring(text, 1, 10).try_cast("date").cast("timestamp"))


def public_text(c: Column, length: int) -> Column:
    """Without control characters, collapsed and cut to ``length``; a blank one is null."""
    plain = F.substring(collapse(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " ")), 1, length)
    return F.when(plain != "", plain)
