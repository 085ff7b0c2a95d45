"""Indicators from submitted texts, addresses and payment payloads: one row a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringtrace.functions import fixed, indicators, text, urls
from ringtrace.functions.text import let
from ringtrace.operators.common import best

#: What is taken of the text of a submitted check: characters, and phones and mails each.
SUBMITTED = {"max_chars": 8000, "per_kind": 10}
HIT = "array<struct<kind:string,raw:string>>"


def hits(value: Column, max_chars: int | None = None, per_kind: int | None = None) -> Column:
    """What a text may name: phones, mails, a whole-text account or link, and itself as a message.

    All of the text and all of its hits, unless there are limits (``SUBMITTED`` for a submitted check).
    """
    t = F.trim(F.coalesce(value, F.lit("")))
    t = t if max_chars is None else F.substring(t, 1, max_chars)
    some = lambda found: found if per_kind is None else F.slice(found, 1, per_kind)
    many = lambda kind, pattern: F.transform(some(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))
    one = lambda kind, fine: F.when(fine, F.array(F.struct(F.lit(kind).alias("kind"), t.alias("raw")))).otherwise(F.array().cast(HIT))
    return F.concat(
        many("phone", r"(?:\+?84|0)[\d\s().-]{8,16}\d"),
        many("email", r"(?<![^\s@])[^\s@]+@[^\s@]+\.[^\s@]{2,}"),
        one("bank_account", t.rlike(r"^[\d\s.-]{6,30}$")),
        one("domain", t.rlike(r"^(?i:https?://|www\.)\S+$")),
        one("message_template", t != ""),
    )


def from_texts(inputs: DataFrame, input_id: str = "input_id", column: str = "text", source: str = "text", max_chars: int | None = None, per_kind: int | None = None) -> DataFrame:
    """input_id, position, kind, raw, value, source of accepted hits; the limits are those of ``hits``."""
    rows = inputs.select(F.col(input_id).alias("input_id"), F.posexplode(hits(F.col(column), max_chars, per_kind)).alias("position", "hit"))
    out = rows.select("input_id", "position", "hit.kind", "hit.raw").withColumn("value", indicators.lookup_value(F.col("kind"), F.col("raw")))
    return out.filter("value <> ''").withColumn("source", F.lit(source))


def from_addresses(inputs: DataFrame) -> DataFrame:
    """The domain of a submitted address."""
    host = urls.domain(urls.lookup_canonical(F.col("url")))
    return inputs.select("input_id", F.lit(0).alias("position"), F.lit("domain").alias("kind"), F.col("url").alias("raw"), host.alias("value"), F.lit("url").alias("source")).filter("value <> ''")


def from_images(inputs: DataFrame) -> DataFrame:
    """The digest of submitted bytes."""
    return inputs.filter(F.col("image").isNotNull()).select("input_id", F.lit(0).alias("position"), F.lit("media_hash").alias("kind"), F.lit("").alias("raw"), F.sha2("image", 256).alias("value"), F.lit("image").alias("source"))


def _crc_table(polynomial: int = 0x1021) -> list[int]:
    """What each leading byte does to a 16-bit checksum."""
    out = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ polynomial if value & 0x8000 else value << 1) & 0xFFFF
        out.append(value)
    return out


def crc16(c: Column) -> Column:
    """CRC-16 of a text's UTF-8 bytes (polynomial 1021, start FFFF), by a table of bytes in a fold."""
    table = F.array(*map(F.lit, _crc_table()))

    def step(value: Column, byte: Column) -> Column:
        lead = F.shiftright(value, 8).bitwiseXOR(byte).bitwiseAND(F.lit(0xFF))
        return F.shiftleft(value, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, lead))

    def bytes_of(digits: Column) -> Column:
        code = lambda i: F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
        each = F.transform(F.sequence(F.lit(1), (F.length(digits) / 2).cast("int")), code)
        return F.when(digits != "", each).otherwise(F.array().cast("array<int>"))

    return F.aggregate(let(F.hex(F.encode(c, "UTF-8")), bytes_of), F.lit(0xFFFF), step)


#: What a walk over fields has: where it is (from 1; 0 once it broke), tags and values so far.
_WALK = "struct<at:int,tags:array<string>,values:array<string>>"


def tagged_fields(c: Column) -> Column:
    """The fields of a text of two digits of tag, two of length, and the value: a map of the first value of each tag, null if the
    lengths do not fit the text.  A walk over it, one field a step."""
    return let(c, _walked)


def _walked(c: Column) -> Column:
    def step(walk: Column, _: Column) -> Column:
        at, size = walk["at"], F.substr(c, walk["at"] + 2, F.lit(2))
        end = at + 4 + size.try_cast("int")
        fine = size.rlike("^[0-9]{2}$") & (end <= F.length(c) + 1)
        tag, value = F.substr(c, at, F.lit(2)), F.substr(c, at + 4, F.coalesce(size.try_cast("int"), F.lit(0)))
        known = F.array_contains(walk["tags"], tag)
        more = F.struct(end.alias("at"), F.when(known, walk["tags"]).otherwise(F.array_append(walk["tags"], tag)).alias("tags"), F.when(known, walk["values"]).otherwise(F.array_append(walk["values"], value)).alias("values"))
        broken = F.struct(F.lit(0).alias("at"), walk["tags"].alias("tags"), walk["values"].alias("values"))
        done = (at == 0) | (at > F.length(c))
        return F.when(done, walk).when(F.coalesce(fine, F.lit(False)), more.cast(_WALK)).otherwise(broken.cast(_WALK))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("values")).cast(_WALK)
    # a field takes four characters at least
    walk = F.aggregate(F.sequence(F.lit(0), (F.length(c) / 4).cast("int")), start, step)
    return let(walk, lambda w: F.when(w["at"] > 0, F.map_from_arrays(w["tags"], w["values"])))


def payment_payload(payload: Column) -> Column:
    """valid, account, reference of merchant-presented QR payloads whose checksum holds.

    Tag 63 is the CRC-16 of all before its value.  Tag 38 holds the account in its field 01, field
    01; tag 62 the reference in fields 05, 08 or 09, the first that is not empty.
    """
    text_ = F.trim(F.coalesce(payload, F.lit("")))
    own = lambda fields, tag: F.coalesce(F.try_element_at(fields, F.lit(tag)), F.lit(""))
    blank = lambda c: F.when(c != "", c)

    def read(s: Column) -> Column:
        told = F.upper(F.right(s, F.lit(4)))
        sound = s.rlike("6304.{4}$") & (F.lpad(F.hex(crc16(F.substr(s, F.lit(1), F.length(s) - 4))), 4, "0") == told)

        def parts(outer: Column) -> Column:
            account = F.try_element_at(tagged_fields(own(tagged_fields(own(outer, "38")), "01")), F.lit("01"))
            more = tagged_fields(own(outer, "62"))
            reference = F.coalesce(*[blank(F.try_element_at(more, F.lit(t))) for t in ("05", "08", "09")])
            fine = F.coalesce(sound & (F.size(outer) > 0), F.lit(False))
            return F.struct(fine.alias("valid"), F.when(fine, account).alias("account"), F.when(fine, reference).alias("reference"))

        return let(tagged_fields(s), parts)

    return let(text_, read)


def from_payloads(inputs: DataFrame, column: str = "qr_payload") -> DataFrame:
    """Payload, account and reference rows; the last two only of payloads whose checksum holds."""
    rows = inputs.select("input_id", F.col(column).alias("payload"), payment_payload(F.col(column)).alias("p"))
    three = F.array(F.struct(F.lit("qr_payload").alias("kind"), F.col("payload").alias("raw")), F.struct(F.lit("bank_account").alias("kind"), F.col("p.account").alias("raw")), F.struct(F.lit("transaction_reference").alias("kind"), F.col("p.reference").alias("raw")))
    each = rows.select("input_id", F.posexplode(three).alias("position", "h")).select("input_id", "position", "h.kind", "h.raw").filter(F.col("raw").isNotNull())
    return each.withColumn("value", indicators.lookup_value(F.col("kind"), F.col("raw"))).filter("value <> ''").withColumn("source", F.lit("decoder"))


def merged(found: DataFrame) -> DataFrame:
    """Hits of all sources, one for each input, kind and value: decoders first, then models, then others."""
    rank = F.when(F.col("source") == "decoder", 0).when(F.col("source") == "model", 1).otherwise(2)
    folded = F.when(F.col("value") == "", text.casefold(F.col("raw"))).otherwise(F.col("value"))
    return best(found.withColumn("_key", F.concat_ws("|", "kind", folded)), ["input_id", "_key"], rank.asc(), F.asc("position"), F.asc("raw")).drop("_key")


def trusted(found: DataFrame) -> DataFrame:
    """Model-read payloads stay only where the decoder agrees; a reference that is the beneficiary's account goes."""
    decoded = found.filter("source = 'decoder' AND kind = 'qr_payload'").select("input_id", F.col("value").alias("_decoded"))
    accounts = found.filter("source = 'decoder' AND kind = 'bank_account'").select("input_id", F.col("value").alias("_account"))
    rows = found.join(decoded, "input_id", "left").join(accounts, "input_id", "left")
    unsure = (F.col("source") == "model") & (F.col("kind") == "qr_payload") & F.col("_decoded").isNotNull() & (F.col("_decoded") != F.col("value"))
    same = (F.col("kind") == "transaction_reference") & (F.col("value") == F.col("_account"))
    return rows.filter(~F.coalesce(unsure, F.lit(False)) & ~F.coalesce(same, F.lit(False))).drop("_decoded", "_account").distinct()


def inferred(lookups: DataFrame) -> DataFrame:
    """What a lookup (lookup_id, query) may be: candidates in order (rank from 0) with kind and value."""
    q = F.trim(F.coalesce("query", F.lit("")))
    digits = text.phone(q)
    number = q.rlike(r"^[+\d\s().-]{6,30}$")
    mail = q.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$")
    link = urls.refanged(q).rlike(r"^(?i:https?://|www\.)\S+$|^(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?:/\S*)?$") & ~mail
    pair = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    options = (
        F.when(number, F.array(pair("phone", digits), pair("bank_account", text.code(q))))
        .when(mail, F.array(pair("email", F.lower(q))))
        .when(link, F.array(pair("url", urls.lookup_canonical(q)), pair("domain", urls.domain(urls.refanged(q)))))
        .when(F.length(q) >= 8, F.array(pair("message_template", text.casefold(text.collapse(q)))))
        .otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    )
    rows = lookups.select("lookup_id", F.posexplode(options).alias("rank", "c"))
    return rows.select("lookup_id", "rank", "c.kind", "c.value").filter("value <> ''")


def evidence_bundle(docs: DataFrame, comments: DataFrame, media: DataFrame) -> DataFrame:
    """What a reviewer gets of a document: its text to 12000 characters, ten comments to 2000, twenty media."""
    said = best(comments, ["document_id"], F.asc("position"), F.asc("body"), n=10).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", F.substring("body", 1, 2000).alias("body")))).alias("comments"))
    seen = best(media, ["document_id"], F.asc("position"), F.asc("url"), n=20).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", "url"))).alias("media"))
    return docs.select("document_id", F.substring("text", 1, 12000).alias("text")).join(said, "document_id", "left").join(seen, "document_id", "left")


def images_wanted(mode: Column, value: Column, images: Column) -> Column:
    """Two distinct images at most: all in mode ``all``, for short texts, or where a term occurs."""
    folded = text.casefold(F.coalesce(value, F.lit("")))
    wanted = (mode == "all") | (F.length(F.trim(F.coalesce(value, F.lit("")))) < 400)
    for term in fixed.IMAGE_TERMS:
        wanted = wanted | folded.contains(term)
    return F.when(wanted, F.slice(F.array_distinct(images), 1, 2)).otherwise(F.array().cast("array<string>"))


def enrichment_needed(value: Column, images: Column) -> Column:
    return (F.size(images) > 0) | (F.length(F.coalesce(value, F.lit(""))) < 400)
