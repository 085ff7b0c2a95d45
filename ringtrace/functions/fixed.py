"""The kinds, weights and word lists that results depend on."""

# fixed values: categories
CATEGORIES = ["scam_report", "impersonation_abuse", "customer_feedback", "news_pr", "noise"]
ELIGIBLE_CATEGORIES = ["scam_report", "impersonation_abuse"]
LEAST_CONFIDENCE = 0.6

# fixed values: indicator kinds and their other names
KINDS = [
    "bank_account", "phone", "email", "domain", "url", "social_account", "person_alias", "organization_alias",
    "qr_payload", "transaction_reference", "payment_method", "money_amount", "media_hash", "message_template",
]
KIND_ALIASES = {
    "account": "bank_account",
    "account_number": "bank_account",
    "bank_account_number": "bank_account",
    "telephone": "phone",
    "phone_number": "phone",
    "mobile": "phone",
    "e_mail": "email",
    "website": "domain",
    "link": "url",
    "social_profile": "social_account",
    "username": "social_account",
    "name": "person_alias",
    "company": "organization_alias",
    "organisation_alias": "organization_alias",
    "qr": "qr_payload",
    "qr_code": "qr_payload",
    "transaction_id": "transaction_reference",
    "amount": "money_amount",
    "image_hash": "media_hash",
    "script": "message_template",
}

# fixed values: kinds that link documents, with their weights
LINK_WEIGHTS = {
    "bank_account": 0.98,
    "phone": 0.95,
    "email": 0.90,
    "domain": 0.80,
    "social_account": 0.85,
    "qr_payload": 0.98,
    "transaction_reference": 0.98,
    "media_hash": 0.98,
}
ROLE_FACTORS = {"anchor": 1.0, "shared": 1.0, "supporting": 0.75, "context": 0.4}

# fixed values: query keys that only track
TRACKING_KEYS = ["fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "ref_src", "igshid", "si"]

# fixed values: hosts of platforms
PLATFORMS = {
    "facebook.com": "facebook",
    "fb.com": "facebook",
    "threads.net": "threads",
    "threads.com": "threads",
    "twitter.com": "x",
    "x.com": "x",
    "reddit.com": "reddit",
    "tiktok.com": "tiktok",
    "instagram.com": "instagram",
    "youtube.com": "youtube",
    "youtu.be": "youtube",
}

# fixed values: words and hosts that name no one in particular (links)
GENERIC_TOKENS = [
    "account", "app", "facebook", "fanpage", "fb", "com", "http", "https", "id", "instagram", "messenger", "me", "net",
    "official", "page", "profile", "reddit", "social", "tai", "khoan", "telegram", "threads", "tiktok", "twitter",
    "user", "username", "whatsapp", "www", "x", "youtube", "zalo",
]
GENERIC_DOMAINS = [
    "facebook.com", "fb.com", "instagram.com", "reddit.com", "t.me", "telegram.me", "threads.com", "threads.net",
    "tiktok.com", "twitter.com", "whatsapp.com", "x.com", "youtube.com", "zalo.me",
]
GENERIC_PAYLOADS = ["none", "not available", "not found", "qr", "qr code", "unknown", "unreadable"]

# fixed values: the same for lookups
LOOKUP_GENERIC_NAMES = ["facebook", "instagram", "messenger", "social", "telegram", "tiktok", "unknown", "wechat", "whatsapp", "zalo"]
LOOKUP_GENERIC_HOSTS = ["facebook.com", "fb.com", "instagram.com", "messenger.com", "t.me", "telegram.org", "tiktok.com", "wechat.com", "whatsapp.com", "zalo.me"]
UNREADABLE_QR = [
    "could not read", "could not read qr", "n/a", "na", "none", "no qr", "not readable", "qr unreadable", "null",
    "unable to read", "unable to read qr", "unreadable", "unreadable qr", "unreadable qr payload", "unknown", "unknown qr",
    "unknown qr payload",
]
QR_SENTINEL_WORDS = [
    "be", "code", "could", "decode", "decoded", "detected", "extract", "extracted", "found", "image", "is", "no", "not",
    "payload", "qr", "read", "readable", "the", "this", "to", "unable", "unknown", "unreadable", "value", "visible",
    "was", "but",
]
QR_UNREADABLE = r"\b(?:unknown|unreadable|not\s+(?:readable|visible|extracted)|unable\s+to\s+(?:read|decode|extract)|could\s+not\s+(?:be\s+)?(?:read|decoded|extracted)|no\s+qr|qr\s+not\s+(?:found|detected))\b"

# fixed values: thresholds
HIGH_SEVERITY, REPEATED_INDICATOR, BURST_SIZE = 4, 2, 3
MATCHED, POSSIBLE, CONTEXTUAL = 0.85, 0.55, 0.75

# fixed values: how kinds of anchors are named in campaign labels
ANCHOR_NAMES = {
    "bank_account": "Bank account",
    "phone": "Phone",
    "email": "Email",
    "domain": "Domain",
    "social_account": "Social account",
    "qr_payload": "QR payload",
    "transaction_reference": "Transaction reference",
    "media_hash": "Shared media",
    "message_template": "Message pattern",
}

# fixed values: what is shown of kinds whose values stay hidden
HIDDEN_NAMES = {
    "account_identifier": "Stored account identifier",
    "message_template": "Stored message pattern",
    "money_amount": "Stored amount signal",
    "organization_alias": "Stored organization alias",
    "payment_method": "Stored payment-method signal",
    "person_alias": "Stored person alias",
}

# fixed values: what to do, by a check's status; a matched campaign's second step depends on its confirmation
ACTIONS = {
    "matched_campaign": [
        "Pause the transfer and do not follow instructions in the submitted evidence.",
        None,
        "Verify the recipient through the bank's official app, website, or card number.",
    ],
    "possible_match": [
        "Pause the transfer while the possible campaign match is reviewed.",
        "Verify the recipient through an independent official channel.",
        "Share the evidence anonymously if this is a concrete attempt.",
    ],
    "new_unmatched_case": [
        "Do not proceed until the recipient and request are independently verified.",
        "Share the evidence anonymously so analysts can assess a new campaign.",
        "Do not install apps, reveal OTPs, or pay an advance fee.",
    ],
}
ACTIONS_BY_CONFIRMATION = {
    True: "Review the confirmed campaign evidence before taking bank action.",
    False: "Treat this as a possible campaign match until an analyst confirms it.",
}
OTHER_ACTIONS = [
    "No concrete scam case was identified in this submission.",
    "If money or credentials are requested, verify through an official channel before proceeding.",
]

# fixed values: words that make a document's images worth reading
IMAGE_TERMS = ["lừa", "scam", "chuyển khoản", "tài khoản", "qr", "mất tiền", "giả mạo", "phishing", "số điện thoại", "biên lai"]

# fixed values: how labels of tactics and bank roles are shown, and what they are
TAXONOMY = {
    "bank_impersonation": ("Bank impersonation", "tactic"),
    "credential_theft": ("Credential theft", "tactic"),
    "phishing": ("Phishing", "tactic"),
    "qr_payment_fraud": ("QR payment fraud", "tactic"),
    "fake_payment_notification": ("Fake payment notice", "tactic"),
    "advance_fee": ("Advance-fee scam", "tactic"),
    "account_takeover": ("Account takeover", "tactic"),
    "malicious_apk": ("Malicious APK", "tactic"),
    "impersonated_bank": ("Impersonated bank", "bank"),
    "receiving_account": ("Receiving account", "bank"),
    "destination_bank": ("Destination bank", "bank"),
}

# fixed values: parts of labels that name a bank, the first that occurs counts
BANKS = {
    "techcombank": "Techcombank",
    "vietcombank": "Vietcombank",
    "vcb": "Vietcombank",
    "tpbank": "TPBank",
    "vpbank": "VPBank",
    "bidv": "BIDV",
    "mb_bank": "MB Bank",
    "mb bank": "MB Bank",
    "acb": "ACB",
}

# fixed values: kinds of indicators as types of graph nodes; others are indicators
NODE_TYPES = {
    "bank_account": "account",
    "phone": "phone",
    "domain": "domain",
    "url": "domain",
    "social_account": "mention",
    "message_template": "phrase",
    "email": "indicator",
    "qr_payload": "indicator",
    "transaction_reference": "indicator",
}

# fixed values: what a check's result says (kicker, heading, context, match; none: the score in percent before the last text)
CONFIRMED_COPY = ("KNOWN CAMPAIGN", "Pause this transfer.", "CONFIRMED CAMPAIGN MATCH", "ANALYST CONFIRMED")
CONTEXTUAL_COPY = ("LIKELY RELATED CAMPAIGN", "Pause this transfer.", "ASSISTED CAMPAIGN RELATIONSHIP", "% RELATIONSHIP CONFIDENCE")
POSSIBLE_COPY = ("POSSIBLE CAMPAIGN MATCH", "Pause this transfer.", "UNCONFIRMED CAMPAIGN EVIDENCE", "% MATCH SCORE")
NEW_COPY = ("NEW UNMATCHED CASE", "Treat this as suspicious.", "NO CAMPAIGN ASSIGNED", "NEW CASE")
OTHER_COPY = ("NO CONCRETE SCAM CASE", "No scam case detected.", "CONSERVATIVE ANALYSIS", "NOT A SPECIFIC CASE")
