"""URL normalisation as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ringtrace.functions import fixed
from ringtrace.functions.text import let


@F.pandas_udf(StringType())
def idna(host: pd.Series) -> pd.Series:
    """Hosts in IDNA form; an Arrow UDF, for tables whose hosts are not all ASCII."""

    def one(h: str | None) -> str | None:
        try:
            return h.encode("idna").decode("ascii") if h and not h.isascii() else h
        except UnicodeError:
            return h

    return host.map(one, na_action="ignore")


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def _host(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_authority(url), "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(F.lower(bare), r"\.+$", "")


def domain(c: Column) -> Column:
    """The host of a URL or host text: lower case, without ``www.``, port and trailing dots."""
    text = F.trim(F.coalesce(c, F.lit("")))
    whole = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("//"), text))
    return F.when(text == "", "").otherwise(F.regexp_replace(_host(whole), r"^www\.", ""))


def canonical(c: Column) -> Column:
    """One spelling of a web address: https by default, lower-case host, no default port, no fragment, no
    trailing slash, no tracking keys, the other query pairs sorted; empty if it is none."""
    text = F.trim(F.coalesce(c, F.lit("")))
    url = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), F.regexp_replace(text, "^/+", "")))

    def parts(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
        port = F.regexp_extract(_authority(u), ":([0-9]+)$", 1)
        usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        path = F.regexp_replace(_quoted(F.regexp_extract(u, "^[^:]*://[^/?#]*([^?#]*)", 1)), "/+$", "")
        pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
        query = F.array_join(F.transform(F.array_sort(F.filter(F.transform(pairs, _pair), lambda p: ~_tracking(F.lower(p["k"])))), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
        whole = F.concat(scheme, F.lit("://"), _host(u), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
        return F.when(scheme.isin("http", "https") & (_host(u) != ""), whole).otherwise("")

    return F.when(text == "", "").otherwise(let(url, parts))


def _quoted(path: Column) -> Column:
    safe = r"[A-Za-z0-9/%:@!$&'()*+,;=\-._~]"
    spelt = F.array_join(F.transform(F.split(path, ""), lambda ch: F.when((ch == "") | ch.rlike(safe), ch).otherwise(F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20")))), "")
    return F.when(path.rlike(rf"^{safe}*$"), path).otherwise(spelt)


def _pair(p: Column) -> Column:
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _tracking(key: Column) -> Column:
    return key.startswith("utm_") | key.isin(*fixed.TRACKING_KEYS)


def refanged(c: Column) -> Column:
    """Addresses written so as not to be links, as links again."""
    scheme = F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*hxxp(s?)://", "http$1://"), r"(?i)^\s*http(s?)\[:\]//", "http$1://")
    return F.regexp_replace(scheme, r"\[\.\]|\(\.\)|\{\.\}", ".")


def lookup_canonical(c: Column) -> Column:
    """:func:`canonical` of a submitted address; one with user and password is none."""
    whole = refanged(F.coalesce(c, F.lit("")))
    return F.when(_authority(whole).contains("@"), "").otherwise(canonical(whole))


def url_key(c: Column) -> Column:
    """SHA-256 of the canonical address; empty for none."""
    return let(canonical(c), lambda u: F.when(u == "", "").otherwise(F.sha2(u, 256)))


def platform(c: Column) -> Column:
    """The platform a host belongs to, else ``web``."""

    def named(host: Column) -> Column:
        out = F.lit("web")
        for suffix, name in reversed(fixed.PLATFORMS.items()):
            out = F.when((host == suffix) | host.endswith("." + suffix), name).otherwise(out)
        return out

    return let(domain(c), named)


def public(c: Column, with_query: bool = True) -> Column:
    """A web address fit to be shown: no user, password or fragment (nor query); else null."""
    bare = F.regexp_replace(F.trim(c), "#.*$", "")
    shown = bare if with_query else F.regexp_replace(bare, r"\?.*$", "")
    return F.when(c.rlike(r"^\s*(?i:https?)://[^/?#\s]+") & ~_authority(F.trim(c)).contains("@"), shown)


def on_domain(host: Column, wanted: Column) -> Column:
    """Whether a host is a domain or lies below it."""
    return (host == wanted) | host.endswith(F.concat(F.lit("."), wanted))
