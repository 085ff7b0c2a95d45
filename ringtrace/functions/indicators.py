"""Indicator values by kind: normal forms, acceptance for links and lookups, labels and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringtrace.functions import fixed, text, urls


def normal_value(kind: Column, value: Column) -> Column:
    """The normal form of a value of a (normalised) kind; empty if there is none."""
    return text.let(text.collapse(value), lambda v: collapsed_value(kind, v))


def collapsed_value(kind: Column, v: Column) -> Column:
    """:func:`normal_value` of a value whose white space is collapsed already."""
    return (
        F.when(v == "", "")
        .when(kind == "phone", text.phone(v))
        .when(kind == "email", text.casefold(v))
        .when(kind == "domain", urls.domain(v))
        .when(kind == "url", urls.canonical(v))
        .when(kind.isin("bank_account", "transaction_reference"), text.code(v))
        .when(kind == "social_account", text.casefold(F.regexp_replace(v, "^@+", "")))
        .when(kind.isin("person_alias", "organization_alias", "payment_method", "message_template"), text.casefold(v))
        .when(kind == "money_amount", text.money(v))
        .when(kind == "media_hash", F.regexp_replace(text.casefold(v), "^sha(?:1|256|512):", ""))
        .otherwise(v)
    )


def key(kind: Column, value: Column) -> Column:
    return F.concat_ws("|", kind, value)


def key_kind(k: Column) -> Column:
    return F.regexp_extract(k, r"^([^|]*)", 1)


def key_value(k: Column) -> Column:
    return F.regexp_extract(k, r"^[^|]*\|(.*)$", 1)


def _generic_handle(value: Column) -> Column:
    tokens = F.regexp_extract_all(_ascii(value), F.lit("[a-z0-9]+"), F.lit(0))
    return F.forall(tokens, lambda t: t.isin(*fixed.GENERIC_TOKENS))


def _ascii(value: Column) -> Column:
    """Lower case, with Latin letters' marks taken off."""
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
    plain = "aaaaaaceeeeiiiinooooouuuuyyadiuouaaaaaaaaaaaaeeeeeeeeiioooooooooooouuuuuuuyyyy"
    return F.translate(F.lower(value), marked, plain)


def links(kind: Column, value: Column) -> Column:
    """Whether a normalised indicator may link documents: one rule a kind, false for all others."""
    v, low = F.trim(value), F.lower(F.trim(value))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "^[@ /]+|[@ /]+$", ""), r"^(?:https?://)?(?:www\.)?", ""), "/+$", "")
    host, path = F.regexp_extract(bare, "^([^/]*)", 1), F.regexp_extract(bare, "^[^/]*/(.*)$", 1)
    handle = F.when(bare.contains("/"), (path != "") & host.isin(*fixed.GENERIC_DOMAINS) & path.rlike(r"^[a-z0-9._~!$&'()*+,;=:@%/-]{2,256}$")).otherwise(bare.rlike(r"^[a-z0-9][a-z0-9._-]{2,63}$"))
    rule = (
        F.when(kind == "bank_account", v.rlike(r"^\d{6,20}$"))
        .when(kind == "phone", v.rlike(r"^0(?:[35789]\d{8}|2\d{8,9})$"))
        .when(kind == "email", low.rlike(r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$"))
        .when(kind == "domain", ~F.regexp_replace(low, r"^www\.", "").isin(*fixed.GENERIC_DOMAINS) & low.rlike(r"^(?:www\.)?(?:[a-z0-9-]+\.)+[a-z0-9-]{2,}$"))
        .when(kind == "social_account", ~v.rlike(r"\s") & ~_generic_handle(v) & ~bare.isin(*fixed.GENERIC_DOMAINS) & handle)
        .when(kind == "qr_payload", ~low.isin(*fixed.GENERIC_PAYLOADS) & (F.length(v) >= 4))
        .when(kind == "transaction_reference", F.upper(v).rlike("^[A-Z0-9]{6,64}$") & v.rlike("[0-9]") & v.rlike(r"^(.)\1*(?!\1)."))
        .when(kind == "media_hash", low.rlike("^[0-9a-f]{16,128}$"))
        .otherwise(F.lit(False))
    )
    return F.coalesce((v != "") & rule, F.lit(False))


def weight(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in fixed.LINK_WEIGHTS.items():
        out = F.when(kind == name, F.lit(w)).otherwise(out)
    return out


def lookup_social(value: Column) -> Column:
    folded = F.regexp_replace(text.casefold(value), "^@", "")
    path = F.filter(F.split(F.regexp_extract(folded, r"^(?:[a-z]+://)?[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    last = F.when(folded.contains("/"), F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(""))).otherwise(folded)
    name = F.regexp_replace(last, "^@", "")
    bad = (F.length(name) < 3) | (F.length(name) > 80) | name.isin(*fixed.LOOKUP_GENERIC_NAMES) | F.regexp_replace(name, r"^www\.", "").isin(*fixed.LOOKUP_GENERIC_HOSTS) | ~name.rlike(r"^[\p{L}\p{N}._-]+$")
    return F.when(bad, "").otherwise(name)


def lookup_qr(value: Column) -> Column:
    folded = text.casefold(value)
    words = F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))
    tokens = F.split(words, " ")
    sentinel = words.rlike(fixed.QR_UNREADABLE) & (F.size(tokens) <= 10) & F.forall(tokens, lambda t: t.isin(*fixed.QR_SENTINEL_WORDS))
    return F.when(folded.isin(*fixed.UNREADABLE_QR) | words.isin(*fixed.UNREADABLE_QR) | sentinel, "").otherwise(value)


def lookup_value(kind: Column, value: Column) -> Column:
    """The normal form of a submitted indicator, or empty if it is not fit to match."""
    return text.let(F.substring(text.collapse(value), 1, 2048), lambda v: _lookup_value(kind, v))


def _lookup_value(kind: Column, v: Column) -> Column:
    mail, host = F.lower(F.substring(v, 1, 320)), urls.domain(urls.refanged(v))
    number, call, reference = text.code(v), text.phone(v), text.code(F.substring(v, 1, 100))
    digest = F.regexp_replace(F.lower(F.substring(v, 1, 180)), "^sha(?:1|256|512):", "")
    message = F.substring(text.casefold(v), 1, 500)
    words = F.filter(F.split(F.regexp_replace(message, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    only = lambda fine, x: F.when(fine, x).otherwise("")
    return F.coalesce(
        F.when(kind == "bank_account", only(number.rlike(r"^\d{6,20}$"), number))
        .when(kind == "phone", only(call.rlike(r"^0(?:[35789]\d{8}|2\d{8,9})$"), call))
        .when(kind == "email", only(mail.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), mail))
        .when(kind == "domain", only(host.contains(".") & (F.length(host) <= 253), host))
        .when(kind == "social_account", lookup_social(v))
        .when(kind == "qr_payload", F.when(v == "", "").otherwise(lookup_qr(v)))
        .when(kind == "transaction_reference", only(~reference.rlike(r"^QRGD\d{10,}$") & F.length(reference).between(6, 64), reference))
        .when(kind == "media_hash", only(digest.rlike("^[a-f0-9]{32,128}$"), digest))
        .when(kind == "message_template", only((F.length(message) >= 12) & (F.size(words) >= 4), message)),
        F.lit(""),
    )


def _tail(name: str | Column, value: Column, n: int) -> Column:
    shown = F.when(value == "", "-" * n).otherwise(F.right(value, F.lit(n)))
    return F.concat(F.lit(name) if isinstance(name, str) else name, F.lit(" ••••"), shown)


def masked(kind: Column, value: Column) -> Column:
    """What may be shown of a value: nothing that tells a person, account or message apart."""
    return text.let(text.collapse(value), lambda v: _masked(kind, v))


def _masked(kind: Column, v: Column) -> Column:
    parts = F.split(v, "@")
    mail = F.concat(F.when(F.get(parts, F.lit(0)) == "", "•").otherwise(F.left(v, F.lit(1))), F.lit("•••@"), F.get(parts, F.lit(1)))
    handle = F.regexp_replace(v, "^@", "")
    host = F.substring_index(F.substring_index(F.substring_index(F.regexp_replace(v, "(?i)^https?://", ""), "/", 1), "?", 1), "#", 1)
    page = urls.public(v, with_query=False)
    out = (
        F.when(kind.isin("bank_account", "phone", "transaction_reference"), _tail(F.replace(kind, F.lit("_"), F.lit(" ")), F.regexp_replace(v, r"[^\p{L}\p{N}]", ""), 4))
        .when(kind == "email", F.when(F.coalesce(F.get(parts, F.lit(1)), F.lit("")) == "", "masked email").otherwise(mail))
        .when(kind == "url", F.when(F.coalesce(page, F.lit("")).rlike("(?i)^https?://"), F.left(F.regexp_replace(F.regexp_replace(page, "(?i)^https?://", ""), "^([^/]+)/$", "$1"), F.lit(180))).otherwise("untrusted URL"))
        .when(kind == "qr_payload", _tail("QR payload", F.regexp_replace(v, r"\s+", ""), 4))
        .when(kind == "domain", F.when(host == "", "stored domain indicator").otherwise(host))
        .when(kind == "media_hash", _tail("media hash", F.regexp_replace(v, "[^A-Fa-f0-9]", ""), 8))
        .when(kind == "social_account", F.when(F.length(handle) > 3, F.concat(F.lit("@"), F.left(handle, F.lit(1)), F.lit("•••"), F.right(handle, F.lit(2)))).otherwise("masked social account"))
    )
    for name, shown in fixed.HIDDEN_NAMES.items():
        out = out.when(kind == name, shown)
    return out.otherwise("Stored campaign indicator")


def masked_key(k: Column) -> Column:
    """A campaign's key with the values of five kinds masked; others are public, and are shown."""
    kind, hidden = key_kind(k), masked(key_kind(k), key_value(k))
    shown = F.when(kind.isin("bank_account", "phone", "transaction_reference", "email", "qr_payload"), F.regexp_replace(hidden, "^.*? ••••", "••••")).otherwise(key_value(k))
    return F.concat_ws(":", kind, shown)


def campaign_key(anchor: Column) -> Column:
    """A key that the anchor alone decides."""
    return F.concat(F.lit("campaign_"), F.substring(F.sha2(F.to_json(F.struct(anchor.alias("anchor_indicator_key"))), 256), 1, 16))


def title_case(value: Column) -> Column:
    """Every run of letters with a capital first, as in a title."""
    runs = F.regexp_extract_all(value, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def campaign_label(scam_type: Column, anchor: Column) -> Column:
    """A label for people: type, kind of anchor, value; types of odd parts are no label."""
    kind, value = key_kind(anchor), key_value(anchor)
    folded = text.casefold(F.trim(F.coalesce(scam_type, F.lit(""))))
    parts = F.filter(F.split(folded, "_"), lambda w: w != "")
    fine = F.size(parts).between(1, 5) & F.forall(parts, lambda w: F.length(w) >= 2) & (F.length(folded) <= 48)
    name = F.lit("Indicator")
    for k, v in fixed.ANCHOR_NAMES.items():
        name = F.when(kind == k, v).otherwise(name)
    cut = F.when(F.length(value) > 36, F.concat(F.left(value, F.lit(33)), F.lit("…"))).otherwise(value)
    shown = F.when(kind.isin("bank_account", "phone", "transaction_reference"), F.concat(F.lit("••••"), F.right(value, F.lit(4)))).otherwise(cut)
    return F.trim(F.concat(F.when(fine, title_case(F.array_join(parts, " "))).otherwise("Suspected Scam"), F.lit(" · "), name, F.lit(" "), shown))
