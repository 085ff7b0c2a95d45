import pytest
from pyspark.sql import functions as F
from ringtrace.functions import indicators, text, urls
from ringtrace.operators import extraction


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text(spark):
    assert apply(spark, text.collapse, ["  a  b\n c ", None, ""]) == ["a b c", "", ""]
    assert apply(spark, text.casefold, ["Straße ΣΑΣ"]) == ["strasse σασ"]
    assert apply(spark, text.kind, ["Phone Number", " e-mail ", "QR code", "Some--Thing!", None]) == ["phone", "email", "qr_payload", "some_thing", ""]
    assert apply(spark, text.phone, ["+84 912 345 678", "84912345678", "0912-345-678", "+1 650 555", "none"]) == ["0912345678", "0912345678", "0912345678", "+1650555", ""]
    assert apply(spark, text.code, [" 12-34 ab", "ＡＢ１２"]) == ["1234AB", "AB12"]
    assert apply(spark, text.timestamp, ["2024-01-02T03:04:05Z", "2024-01-02 junk", "junk"])[2] is None
    assert apply(spark, lambda c: text.clamped(c, 0, 1, 0.5), ["2", "-1", "x", None]) == [1.0, 0.0, 0.5, 0.5]
    assert apply(spark, lambda c: text.within(c, 0, 1, 0.5), ["2", "0.25", "x", None]) == [0.5, 0.25, 0.5, 0.5]
    assert apply(spark, text.truthy, ["Yes", "có", "0", None]) == [True, True, False, False]
    assert apply(spark, lambda c: text.public_text(c, 5), ["a\x00b  cdefgh", " \n"]) == ["a b c", None]
    assert apply(spark, text.nfkc, ["ﬁ①", None]) == ["fi1", None]


@pytest.mark.parametrize(("raw", "want"), [("1.500.000 đồng", "1500000 VND"), ("$12.50", "12.5 USD"), ("1.234,56 €", "1234.56 EUR"), ("12,5", "12.5"), ("free", "FREE"), ("1,234.50 USD", "1234.5 USD"), ("100", "100")])
def test_money(spark, raw, want):
    assert apply(spark, text.money, [raw]) == [want]


def test_urls(spark):
    raw = ["HTTPS://www.Example.com:443/a/?utm_source=x&b=2&a=1#f", "example.com/", "ftp://x.y", "http://e.com:8080/p q?x=%20y&fbclid=1", None, "http://u:p@e.com/"]
    assert apply(spark, urls.canonical, raw) == ["https://www.example.com/a?a=1&b=2", "https://example.com", "", "http://e.com:8080/p%20q?x=+y", "", "http://e.com"]
    assert apply(spark, urls.domain, ["https://www.A.com.:80/x", "b.org", "", None]) == ["a.com", "b.org", "", ""]
    assert apply(spark, urls.lookup_canonical, ["hxxps://a[.]com/x/", "http://u:p@e.com/"]) == ["https://a.com/x", ""]
    assert apply(spark, urls.platform, ["https://m.facebook.com/x", "youtu.be/1", "notfacebook.com"]) == ["facebook", "youtube", "web"]
    assert apply(spark, urls.public, ["https://a.com/x?q#f", "javascript:1", "http://u:p@a.com"]) == ["https://a.com/x?q", None, None]
    assert apply(spark, urls.idna, ["bücher.example", "a.b", None]) == ["xn--bcher-kva.example", "a.b", None]


LINKS = [
    ("bank_account", "001234567890", True), ("bank_account", "BIDV", False), ("phone", "0912345678", True), ("phone", "0112345678", False), ("email", "a.b@c.example", True), ("email", "a@b", False),
    ("domain", "facebook.com", False), ("domain", "scam.example", True), ("social_account", "zalo official", False), ("social_account", "facebook", False), ("social_account", "seller.one", True),
    ("social_account", "facebook.com/seller1", True), ("social_account", "other.com/seller1", False), ("qr_payload", "unreadable", False), ("qr_payload", "00020101", True), ("transaction_reference", "ABCDEF", False),
    ("transaction_reference", "111111", False), ("transaction_reference", "FT1234", True), ("media_hash", "0123456789abcdef", True), ("media_hash", "xyz", False), ("message_template", "send money to this account", False), ("phone", None, False),
]


def test_links(spark):
    rows = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(LINKS)], "i int, k string, v string")
    got = [r.o for r in rows.select("i", indicators.links(F.col("k"), F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == [w for _, _, w in LINKS]


LOOKUPS = [
    ("bank_account", "0012 3456-789", "00123456789"), ("bank_account", "VCB", ""), ("phone", "+84 912 345 678", "0912345678"), ("email", "A@B.example", "a@b.example"), ("domain", "hxxps://www.Bad[.]example/x", "bad.example"),
    ("social_account", "https://t.me/Seller_1/", "seller_1"), ("social_account", "@telegram", ""), ("qr_payload", "QR code is not readable", ""), ("qr_payload", "0002010102", "0002010102"),
    ("transaction_reference", "QRGD1234567890", ""), ("transaction_reference", "ft 12-34", "FT1234"), ("media_hash", "sha256:" + "a" * 64, "a" * 64), ("message_template", "Send money now", ""), ("message_template", "Please send the money now", "please send the money now"), ("other", "x", ""),
]


def test_lookup_values(spark):
    rows = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(LOOKUPS)], "i int, k string, v string")
    got = [r.o for r in rows.select("i", indicators.lookup_value(F.col("k"), F.col("v")).alias("o")).orderBy("i").collect()]
    assert got == [w for _, _, w in LOOKUPS]


def test_masks(spark):
    keys = ["bank_account|001234567890", "email|abc@d.example", "social_account|seller1", "message_template|short", "qr_payload|QR 12 34"]
    assert apply(spark, indicators.masked_key, keys) == ["bank_account:••••7890", "email:a•••@d.example", "social_account:seller1", "message_template:short", "qr_payload:••••1234"]
    shown = lambda c: indicators.masked(indicators.key_kind(c), indicators.key_value(c))
    keys += ["url|https://u:p@a.example/x?y=1", "url|https://a.example/?q", "url|ftp://x", "media_hash|sha256:00aa11bb22cc", "transaction_reference|--", "person_alias|Jane Doe", "domain|https://a.b/c", "social_account|@ab", "email|nobody", "other|x"]
    assert apply(spark, shown, keys) == [
        "bank account ••••7890", "a•••@d.example", "@s•••r1", "Stored message pattern", "QR payload ••••1234", "untrusted URL", "a.example", "untrusted URL", "media hash ••••11bb22cc",
        "transaction reference ••••----", "Stored person alias", "a.b", "masked social account", "masked email", "Stored campaign indicator",
    ]


def test_labels(spark):
    rows = spark.createDataFrame([("loan_scam", "phone|0912345678"), ("1_urgent", "email|" + "x" * 40), (None, "other|v"), ("a_b", "domain|a.b"), ("ROMANCE_scam2x", "qr_payload|q")], "t string, k string")
    got = [r.o for r in rows.select(indicators.campaign_label(F.col("t"), F.col("k")).alias("o")).collect()]
    assert got == ["Loan Scam · Phone ••••5678", "Suspected Scam · Email " + "x" * 33 + "…", "Suspected Scam · Indicator v", "Suspected Scam · Domain a.b", "Romance Scam2X · QR payload q"]


def test_extraction(spark):
    rows = spark.createDataFrame([("a", "call 0912 345 678 or 0912345678 and mail x@y.example"), ("b", "001234567890"), ("c", None)], "input_id string, text string")
    got = {(r.input_id, r.kind, r.value) for r in extraction.merged(extraction.from_texts(rows)).collect()}
    assert ("a", "phone", "0912345678") in got and ("a", "email", "x@y.example") in got and ("b", "bank_account", "001234567890") in got
    assert sum(k == "phone" for _, k, _ in got) == 1


def test_extraction_takes_whole_texts(spark):
    late, mails = "word " * 2000 + "call 0912345678", " ".join(f"m{i}@x.example" for i in range(25))
    rows = spark.createDataFrame([("late", late), ("mails", mails), ("run", "x" * 300_000 + " a@b.example@c.example")], "input_id string, text string")
    count = lambda **limits: {(r.input_id, r.kind): r["count"] for r in extraction.from_texts(rows, **limits).filter("kind IN ('phone', 'email')").groupBy("input_id", "kind").count().collect()}
    assert count() == {("late", "phone"): 1, ("mails", "email"): 25, ("run", "email"): 1}
    assert count(**extraction.SUBMITTED) == {("mails", "email"): 10}


def payload(account, reference):
    def crc(s):
        v = 0xFFFF
        for b in s.encode():
            v ^= b << 8
            for _ in range(8):
                v = ((v << 1) ^ 0x1021 if v & 0x8000 else v << 1) & 0xFFFF
        return f"{v:04X}"

    f = lambda t, v: f"{t}{len(v):02d}{v}"
    s = f("00", "01") + f("38", f("00", "A000") + f("01", f("00", "970") + f("01", account))) + f("62", f("08", reference)) + "6304"
    return s + crc(s)


def test_payment_payloads(spark):
    good = payload("0011223344", "FT123456")
    rows = spark.createDataFrame([("a", good), ("b", good[:-1] + ("0" if good[-1] != "0" else "1")), ("c", None)], "input_id string, qr_payload string")
    found = extraction.from_payloads(rows)
    got = {(r.input_id, r.kind, r.value) for r in found.collect()}
    assert {("a", "bank_account", "0011223344"), ("a", "transaction_reference", "FT123456"), ("a", "qr_payload", good)} <= got
    assert not any(i == "b" and k != "qr_payload" for i, k, _ in got)
    assert extraction.trusted(found).count() == len(got)


def test_inferred(spark):
    rows = spark.createDataFrame([("a", "0912 345 678"), ("b", "hxxps://bad[.]example/x"), ("c", "x@y.example"), ("d", "you have won a prize"), ("e", "short")], "lookup_id string, query string")
    got = {}
    for r in extraction.inferred(rows).orderBy("lookup_id", "rank").collect():
        got.setdefault(r.lookup_id, []).append((r.kind, r.value))
    assert got == {"a": [("phone", "0912345678"), ("bank_account", "0912345678")], "b": [("url", "https://bad.example/x"), ("domain", "bad.example")], "c": [("email", "x@y.example")], "d": [("message_template", "you have won a prize")]}


def test_payload_walk_and_checksum_equal_a_plain_version(spark):
    import random

    rng = random.Random(9)

    def fields(t):
        out, at = {}, 0
        while at < len(t):
            size = t[at + 2 : at + 4]
            if len(size) < 2 or not size.isdigit() or at + 4 + int(size) > len(t):
                return None
            out.setdefault(t[at : at + 2], t[at + 4 : at + 4 + int(size)])
            at += 4 + int(size)
        return out

    f = lambda t, v: f"{t}{len(v):02d}{v}"
    some = lambda: "".join(rng.choice("012Aé đ") for _ in range(rng.randrange(0, 12)))
    texts = ["", "0", "0002", "00020", "000201", "0002010002xx", "00xx01", "12345678", *("".join(f(f"{rng.randrange(4):02d}", some()) for _ in range(rng.randrange(1, 9))) for _ in range(60))]
    texts += [t[: rng.randrange(len(t))] for t in texts if t] + ["".join(f(f"{i:02d}", "x" * 90) for i in range(60))]
    assert apply(spark, extraction.tagged_fields, texts) == [fields(t) for t in texts]
    assert apply(spark, lambda c: F.lpad(F.hex(extraction.crc16(c)), 4, "0"), ["123456789", "", *texts]) == ["29B1", "FFFF", *(payload_crc(t) for t in texts)]
    whole = [payload("0011223344", "FT123456"), payload("1", ""), "00020163049999", None, "  " + payload("7", "R1") + " "]
    assert [tuple(r) for r in apply(spark, extraction.payment_payload, whole)] == [(True, "0011223344", "FT123456"), (True, "1", None), (False, None, None), (False, None, None), (True, "7", "R1")]


def payload_crc(t):
    v = 0xFFFF
    for byte in t.encode():
        v ^= byte << 8
        for _ in range(8):
            v = ((v << 1) ^ 0x1021 if v & 0x8000 else v << 1) & 0xFFFF
    return f"{v:04X}"
