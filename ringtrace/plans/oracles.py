"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ringtrace.functions import fixed

_CASES = r"""
docs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS document_id,
         CASE o_custkey % 5 WHEN 0 THEN 'scam_report' WHEN 1 THEN 'impersonation_abuse' WHEN 2 THEN 'customer_feedback' WHEN 3 THEN 'news_pr' ELSE 'noise' END AS category,
         CAST(o_orderkey * 37 % 101 AS DOUBLE) / 100 AS confidence, o_orderkey % 4 <> 0 AS specific_case, CAST(o_orderkey % 6 AS INTEGER) AS severity,
         trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS scam_type, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS bank_role,
         o_orderdate AS first_seen, coalesce(shipped, o_orderdate) AS last_seen
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
), items AS (
  SELECT document_id, p, c, l_linenumber, lpad(CAST(p % 100000000 AS VARCHAR), 8, '0') AS padded
  FROM (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, 1 - l_discount AS c, l_linenumber,
               CAST(l_partkey AS BIGINT) * 1000 + coalesce(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)), 0) // 7 AS p FROM lineitem)
), edges AS (
  SELECT document_id, kind, kind || '|' || value AS key, max(round(c, 2)) AS confidence, min(shown) AS display_value, max(w) AS w, 'line ' || arg_min(l_linenumber, l_linenumber - 100 * round(c, 2)) AS quote FROM (
    SELECT document_id, c, l_linenumber, CASE p % 8 WHEN 0 THEN 'bank_account' WHEN 1 THEN 'phone' WHEN 2 THEN 'email' WHEN 3 THEN 'domain' WHEN 4 THEN 'social_account' WHEN 5 THEN 'qr_payload' WHEN 6 THEN 'transaction_reference' ELSE 'media_hash' END AS kind,
      CASE p % 8 WHEN 0 THEN '1000' || padded WHEN 1 THEN '09' || padded WHEN 2 THEN 'p' || p || '@shop.example' WHEN 3 THEN 'p' || p || '.example.com' WHEN 4 THEN 'seller' || p WHEN 5 THEN 'QRPAY ' || p WHEN 6 THEN 'REF1' || padded ELSE md5(CAST(p AS VARCHAR)) END AS value,
      CASE p % 8 WHEN 0 THEN '1000' || padded WHEN 1 THEN '+849' || padded WHEN 2 THEN 'P' || p || '@shop.example' WHEN 3 THEN 'www.p' || p || '.example.com' WHEN 4 THEN '@seller' || p WHEN 5 THEN 'QRPAY ' || p WHEN 6 THEN 'ref-1' || padded ELSE 'sha256:' || md5(CAST(p AS VARCHAR)) END AS shown,
      CASE p % 8 WHEN 1 THEN 0.95 WHEN 2 THEN 0.90 WHEN 3 THEN 0.80 WHEN 4 THEN 0.85 ELSE 0.98 END AS w
    FROM items)
  GROUP BY 1, 2, 3
)
"""


def _components(edges: str, node: str = "document_id") -> str:
    """CTEs of the components of a table of edges (node, key)."""
    return f"""
near AS (SELECT DISTINCT a.{node} AS a, b.{node} AS b FROM {edges} a JOIN (SELECT key, min({node}) AS {node} FROM {edges} GROUP BY key) b ON a.key = b.key AND a.{node} <> b.{node}),
both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
components AS (SELECT node AS {node}, min(other) AS component FROM reach GROUP BY node)
"""


_SCORED = r"""
keys AS (
  SELECT component, key, max(w) AS w, count(DISTINCT document_id) AS n FROM edges JOIN components USING (document_id) GROUP BY 1, 2
), shared AS (
  SELECT component, key, w, n, row_number() OVER (PARTITION BY component ORDER BY w DESC, n DESC, key) AS r FROM keys WHERE n > 1
), anchors AS (
  SELECT component, key AS anchor, 'campaign_' || substr(sha256('{"anchor_indicator_key":"' || key || '"}'), 1, 16) AS campaign_key FROM shared WHERE r = 1
), whole AS (
  SELECT component, count(*) AS document_count, max(severity) AS maximum_severity, round(avg(confidence), 6) AS average_confidence, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
         string_agg(DISTINCT scam_type, ',' ORDER BY scam_type) AS scam_types, string_agg(DISTINCT bank_role, ',' ORDER BY bank_role) AS bank_roles, min(scam_type) AS first_type
  FROM docs JOIN components USING (document_id) GROUP BY 1
), clusters AS (
  SELECT *, round(CAST(maximum_severity + 0.2 * least(document_count, 10) AS DOUBLE), 4) AS risk_score FROM whole JOIN anchors USING (component)
), reasons AS (
  SELECT component, document_id, kind, key, e.w, confidence, round(e.w * confidence, 4) AS contribution, n, quote FROM edges e JOIN components USING (document_id) JOIN (SELECT component, key, n FROM shared) USING (component, key)
), members AS (
  SELECT campaign_key, component, document_id, round(1 - product(1 - contribution), 4) AS membership_score FROM reasons JOIN anchors USING (component) GROUP BY 1, 2, 3
), roles AS (
  SELECT campaign_key, k.key, CASE WHEN k.key = anchor THEN 'anchor' WHEN n > 1 THEN 'shared' ELSE 'supporting' END AS role,
         CASE WHEN n > 1 THEN w WHEN k.key = anchor THEN 1.0 ELSE 0.5 END AS weight
  FROM keys k JOIN anchors USING (component)
), registry AS (
  SELECT *, CASE WHEN h % 7 = 0 THEN 'dismissed' WHEN h % 3 = 0 THEN 'confirmed' ELSE 'provisional' END AS status
  FROM (SELECT *, CAST('0x' || substr(campaign_key, 10, 4) AS INTEGER) AS h FROM clusters)
)
"""


def _digest(c: str) -> str:
    return f"bit_xor(CAST('0x' || left(md5({c}), 15) AS BIGINT))"


def _listed(rows: str, key: str, value: str, name: str) -> str:
    """key, part, ``name`` of ``rows``: a group's different values in order, in parts of some 1000 by md5."""
    return f"""(SELECT {key}, part, string_agg({value}, ',' ORDER BY {value}) AS {name} FROM (
      SELECT {key}, {value}, CAST('0x' || left(md5({value}), 8) AS BIGINT) % ((count(*) OVER (PARTITION BY {key}) + 999) // 1000) AS part FROM (SELECT DISTINCT {key}, {value} FROM {rows})) GROUP BY 1, 2)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


#: All documents as cases, with their longer lines as indicators.
_LINE_CASES = r"""
docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE doc_id % 5 WHEN 0 THEN 'scam_report' WHEN 1 THEN 'impersonation_abuse' WHEN 2 THEN 'customer_feedback' WHEN 3 THEN 'news_pr' ELSE 'noise' END AS category,
         CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS confidence, doc_id % 4 <> 0 AS specific_case, CAST(doc_id % 6 AS INTEGER) AS severity, lang AS scam_type, source AS bank_role,
         TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 366) AS first_seen, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 366) AS last_seen
  FROM documents
), edges AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS document_id, 'media_hash' AS kind, 'media_hash|' || sha256(md5(trim(line, ' '))) AS key, 0.9::DOUBLE AS confidence, 0.98 AS w, 'line' AS quote
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line, ' ')) >= 24
)
"""
_GRAPH, _LINE_GRAPH = (_CASES, _components("edges"), _SCORED), (_LINE_CASES, _components("edges"), _SCORED)
_SHOWN = r"""CASE split_part(key, '|', 1)
  WHEN 'email' THEN left(v, 1) || '•••@' || split_part(v, '@', 2) WHEN 'social_account' THEN '@' || left(v, 1) || '•••' || right(v, 2)
  WHEN 'domain' THEN v WHEN 'qr_payload' THEN 'QR payload ••••' || right(regexp_replace(v, '\s+', '', 'g'), 4) WHEN 'media_hash' THEN 'media hash ••••' || right(v, 8)
  ELSE replace(split_part(key, '|', 1), '_', ' ') || ' ••••' || right(v, 4) END"""
_MASK = r"""split_part(key, '|', 1) || ':' || CASE split_part(key, '|', 1)
  WHEN 'email' THEN left(v, 1) || '•••@' || split_part(v, '@', 2) WHEN 'social_account' THEN v WHEN 'domain' THEN v WHEN 'media_hash' THEN v WHEN 'qr_payload' THEN '••••' || right(regexp_replace(v, '\s+', '', 'g'), 4) ELSE '••••' || right(v, 4) END"""
_LABEL = r"""'Suspected Scam · ' || CASE split_part(key, '|', 1) WHEN 'bank_account' THEN 'Bank account' WHEN 'phone' THEN 'Phone' WHEN 'email' THEN 'Email' WHEN 'domain' THEN 'Domain'
  WHEN 'social_account' THEN 'Social account' WHEN 'qr_payload' THEN 'QR payload' WHEN 'transaction_reference' THEN 'Transaction reference' WHEN 'media_hash' THEN 'Shared media' END || ' ' ||
  CASE WHEN split_part(key, '|', 1) IN ('bank_account', 'phone', 'transaction_reference') THEN '••••' || right(v, 4) WHEN length(v) > 36 THEN left(v, 33) || '…' ELSE v END"""
#: Clusters of eligible documents alone, and the anomalies of all.
_ELIGIBLE = """
all_edges AS (SELECT * FROM edges), eligible_edges AS (
  SELECT e.* FROM edges e JOIN docs d ON e.document_id = d.document_id WHERE {rule}
)
"""
_ANOMALIES = r"""
eligible_keys AS (
  SELECT component, key, max(w) AS w, count(DISTINCT document_id) AS n FROM eligible_edges JOIN components USING (document_id) GROUP BY 1, 2
), named AS (
  SELECT component, 'campaign_' || substr(sha256('{{"anchor_indicator_key":"' || key || '"}}'), 1, 16) AS campaign_key
  FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY w DESC, n DESC, key) AS r FROM eligible_keys WHERE n > 1) WHERE r = 1
), found AS (
  SELECT 'high_severity_' || substr(sha256(document_id), 1, 16) AS anomaly_key, 'high_severity' AS anomaly_type, CAST(severity AS DOUBLE) AS observed, {severe}::DOUBLE AS threshold, 1::BIGINT AS document_count, NULL::VARCHAR AS campaign_key, NULL::VARCHAR AS indicator_key
  FROM docs WHERE severity >= {severe}
  UNION ALL SELECT 'repeated_indicator_' || substr(sha256(key), 1, 16), 'repeated_indicator', count(DISTINCT document_id), {repeats}, count(DISTINCT document_id), NULL, key FROM eligible_edges GROUP BY key HAVING count(DISTINCT document_id) >= {repeats}
  UNION ALL SELECT 'burst_size_' || campaign_key, 'burst_size', count(*), {burst}, count(*), campaign_key, NULL FROM components JOIN named USING (component) GROUP BY campaign_key HAVING count(*) >= {burst}
), behind AS (
  SELECT anomaly_key, document_id, NULL::VARCHAR AS indicator_key FROM found JOIN docs ON anomaly_key = 'high_severity_' || substr(sha256(document_id), 1, 16)
  UNION SELECT anomaly_key, NULL, key FROM found JOIN docs d ON anomaly_key = 'high_severity_' || substr(sha256(document_id), 1, 16) JOIN edges e ON e.document_id = d.document_id
  UNION SELECT anomaly_key, document_id, NULL FROM found JOIN eligible_edges ON indicator_key = key
  UNION SELECT anomaly_key, NULL, indicator_key FROM found WHERE anomaly_type = 'repeated_indicator'
  UNION SELECT anomaly_key, document_id, NULL FROM found JOIN named USING (campaign_key) JOIN components USING (component)
  UNION SELECT anomaly_key, NULL, key FROM found JOIN named USING (campaign_key) JOIN eligible_keys USING (component) WHERE n > 1
)
"""
_MATCH = r"""
matches AS (
  SELECT e.document_id AS input_id, r.campaign_key, round(1 - product(1 - weight * CASE role WHEN 'supporting' THEN 0.75 ELSE 1 END), 4) AS match_score, bool_or(role = 'anchor') AS anchor_match, count(*) AS n_reasons
  FROM edges e JOIN roles r ON e.key = r.key JOIN registry g ON g.campaign_key = r.campaign_key AND g.status <> 'dismissed' GROUP BY 1, 2
), best AS (
  SELECT * FROM (SELECT m.*, g.status = 'confirmed' AS confirmed, row_number() OVER (PARTITION BY input_id ORDER BY anchor_match DESC, match_score DESC, g.status = 'confirmed' DESC, risk_score DESC, document_count DESC, m.campaign_key) AS r
  FROM matches m JOIN registry g USING (campaign_key)) WHERE r = 1
), checks AS (
  SELECT d.document_id AS input_id, campaign_key, match_score, coalesce(confirmed, false) AS confirmed,
    CASE WHEN NOT (specific_case AND category IN ('scam_report', 'impersonation_abuse'))
         THEN CASE WHEN category = 'noise' AND coalesce(anchor_match, false) THEN CASE WHEN confirmed THEN 'matched_campaign' ELSE 'possible_match' END ELSE 'not_scam' END
         WHEN coalesce(anchor_match, false) OR coalesce(match_score, 0) >= 0.85 THEN 'matched_campaign' WHEN coalesce(match_score, 0) >= 0.55 THEN 'possible_match' ELSE 'new_unmatched_case' END AS status
  FROM docs d LEFT JOIN best ON input_id = d.document_id
)
"""
_NODES_LINKS = rf"""
alive AS (SELECT *, anchor AS key, regexp_extract(anchor, '\|(.*)$', 1) AS v FROM registry WHERE status <> 'dismissed'
), tags AS (
  SELECT campaign_key, average_confidence, status, 'tactic' AS type, unnest(string_split(scam_types, ',')[1:3]) AS raw FROM alive UNION ALL SELECT campaign_key, average_confidence, status, 'bank', unnest(string_split(bank_roles, ',')[1:2]) FROM alive
), tagged AS (
  SELECT *, type || '-' || replace(raw, '_', '-') AS id, list_aggregate(list_transform(string_split(raw, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label FROM tags
), evidence AS (
  SELECT * FROM (SELECT m.*, a.status, severity, row_number() OVER (PARTITION BY m.campaign_key ORDER BY membership_score DESC, m.document_id) AS r FROM members m JOIN alive a USING (campaign_key) JOIN docs d ON d.document_id = m.document_id) WHERE r <= 8
), marks AS (
  SELECT *, 'indicator-' || sha256(key) AS id, regexp_extract(key, '\|(.*)$', 1) AS v FROM (SELECT r.*, a.status, row_number() OVER (PARTITION BY campaign_key ORDER BY role, r.weight DESC, r.key) AS k FROM roles r JOIN (SELECT campaign_key, status FROM alive) a USING (campaign_key)) WHERE k <= 24
), nodes AS (
  SELECT 'registry-live-campaigns' AS id, 'Live campaign registry' AS label, 'registry' AS type, 22::DOUBLE AS size, 'live' AS status FROM alive HAVING count(*) > 0
  UNION ALL SELECT 'campaign-' || campaign_key, {_LABEL}, 'campaign', round(least(24, 16 + sqrt(document_count)), 6), CASE WHEN status = 'confirmed' THEN 'confirmed' ELSE 'provisional' END FROM alive
  UNION SELECT id, label, type, 11, NULL FROM tagged
  UNION ALL SELECT 'evidence-' || document_id, CASE WHEN severity > 1 THEN 'Case ' || document_id ELSE 'Untitled document' END, 'evidence', round(11 + membership_score * 4, 6), 'observed' FROM evidence
  UNION ALL SELECT id, {_SHOWN}, CASE split_part(key, '|', 1) WHEN 'bank_account' THEN 'account' WHEN 'phone' THEN 'phone' WHEN 'domain' THEN 'domain' WHEN 'social_account' THEN 'mention' ELSE 'indicator' END, CASE role WHEN 'anchor' THEN 15 WHEN 'shared' THEN 13 ELSE 10 END, role FROM marks
), links AS (
  SELECT 'registry-live-campaigns' AS source, 'campaign-' || campaign_key AS target, 'ACTIVE_CAMPAIGN' AS relation, 'confirmed' AS status, 0.62::DOUBLE AS weight FROM alive
  UNION ALL SELECT 'campaign-' || campaign_key, id, CASE type WHEN 'bank' THEN 'BANK_ROLE' ELSE 'SCAM_TYPE' END, CASE WHEN status = 'confirmed' THEN 'confirmed' ELSE 'suggested' END, round(greatest(0.55, average_confidence), 6) FROM tagged
  UNION ALL SELECT 'campaign-' || campaign_key, 'evidence-' || document_id, 'SOURCE_EVIDENCE', 'suggested', membership_score FROM evidence
  UNION ALL SELECT 'campaign-' || campaign_key, id, upper(role), CASE WHEN status = 'confirmed' THEN 'confirmed' ELSE 'suggested' END, round(weight, 4) FROM marks
)
"""
_EVENTS = r"""
e AS (SELECT event_id, ts, 'job-' || (user_id % 20) AS job_id, 'u' || coalesce(json_extract_string(props, '$.k'), '-') AS url_key, event_type, value FROM events)
"""
_HOST = "regexp_replace(regexp_extract(url, '://([^/?#:]*)', 1), '^www\\.', '')"
_CANON = r"""rtrim(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), '/')"""
_QUERY = r"""coalesce((SELECT '?' || string_agg(x, '&' ORDER BY x) FROM (SELECT unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS x) WHERE x <> '' AND NOT starts_with(x, 'utm_')), '')"""


def _anomalies(body: str, cases: str = _CASES) -> str:
    rule = "d.specific_case AND d.category IN ('scam_report', 'impersonation_abuse') AND d.confidence >= " + str(fixed.LEAST_CONFIDENCE)
    return _with(cases, _ELIGIBLE.format(rule=rule), _components("eligible_edges"), _ANOMALIES.format(severe=fixed.HIGH_SEVERITY, repeats=fixed.REPEATED_INDICATOR, burst=fixed.BURST_SIZE)) + " " + body


ORACLES: dict[str, str] = {
    "s1_filtered_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 100000 AND 200000 AND o_orderpriority <> '5-LOW'",
    "s1_newest_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100",
    "s2_full_read": "SELECT l_orderkey || '-' || l_linenumber AS id, strftime(max(l_shipdate), '%Y-%m-%d') AS shipped FROM lineitem GROUP BY 1",
    "s3_upsert": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0",
    "s4_replace_children": "WITH new AS (SELECT l_orderkey, l_linenumber, 0.0::DOUBLE AS l_quantity FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1) SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new",
    "s5_snapshot_refresh": "SELECT c_custkey, c_mktsegment, c_custkey % 3 = 0 AS is_active FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "s6_nested_read": "SELECT o_orderkey, o_orderstatus, coalesce(string_agg(l_linenumber || ':' || CAST(trunc(l_quantity) AS INTEGER), ',' ORDER BY l_linenumber, l_quantity), '') AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "s7_embedded": _with(_CASES) + " SELECT CASE WHEN severity > 2 THEN category END AS category, count(*) AS n, 'all' AS mode FROM docs GROUP BY 1 UNION ALL SELECT category, count(*), 'chosen' FROM docs WHERE severity > 2 AND category = 'noise' GROUP BY 1",
    "s8_search_results": f"SELECT page_id AS query_id, CAST(CASE WHEN page_id % 2 = 0 THEN page_id ELSE 1 END AS INTEGER) AS position, 'page ' || page_id AS title, url, {_HOST} AS site FROM pages WHERE page_id % 7 <> 0",
    "s9_domain_filter": f"SELECT page_id FROM pages WHERE {_HOST} LIKE '%.example.net' OR {_HOST} = 'example.net' OR {_HOST} = 'tionsh.example.com' OR {_HOST} LIKE '%.tionsh.example.com'",
    "s14_provenance": "WITH " + _EVENTS + " SELECT job_id, event_type AS query_id, url_key AS document_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS found_at FROM e GROUP BY 1, 2, 3",
    "s11_metric_rows": _with(_CASES) + r""" SELECT 'summary' AS metric_scope, 'global' AS metric_key, '{"document_count":' || (SELECT count(*) FROM docs) || ',"unique_indicator_count":' || count(DISTINCT key) || '}' AS metric_value FROM edges
        UNION ALL SELECT 'category', category, '{"document_count":' || count(*) || '}' FROM docs GROUP BY category
        UNION ALL SELECT 'severity', CAST(severity AS VARCHAR), '{"document_count":' || count(*) || '}' FROM docs GROUP BY severity
        UNION ALL SELECT 'indicator', key, '{"document_count":' || count(*) || '}' FROM edges GROUP BY key""",
    "n4_canonical_urls": f"SELECT page_id, c AS canonical, domain, sha256(c) AS url_key, 'web' AS platform FROM (SELECT page_id, {_CANON} || {_QUERY} AS c, {_HOST} AS domain FROM pages)",
    "n5_refanged": f"SELECT page_id, {_CANON} || {_QUERY} AS canonical, regexp_replace(url, '[?#].*$', '') AS public FROM pages",
    "n10_phones_and_accounts": "SELECT p_partkey, '0' || lpad(CAST(p_partkey AS VARCHAR), 9, '9') AS phone, 'AB' || p_partkey AS code, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS label FROM part",
    "n12_money": r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN regexp_replace(s, '[.].*', '') ELSE regexp_replace(regexp_replace(s, '(\.[0-9]*?)0+$', '\1'), '\.$', '') END || CASE p_partkey % 3 WHEN 0 THEN ' USD' WHEN 1 THEN ' EUR' ELSE ' VND' END AS money FROM (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR) AS s FROM part)""",
    "n16_indicator_values": _with(_CASES) + " SELECT document_id, key, confidence FROM edges",
    "n19_classification": _with(_CASES) + " SELECT document_id, CASE WHEN severity = 0 THEN 'noise' ELSE category END AS category, CAST(least(5, greatest(1, round_even(confidence * 8, 0))) AS INTEGER) AS severity, round(least(1, greatest(0, confidence * 1.5 - 0.2)), 6) AS confidence, scam_type AS scam_types FROM docs",
    "n25_masks": _with(_CASES) + f" SELECT DISTINCT key, {_MASK} AS masked, {_SHOWN} AS shown FROM (SELECT key, regexp_extract(key, '\\|(.*)$', 1) AS v FROM edges)",
    "n24_labels": _with(*_GRAPH) + f" SELECT campaign_key, {_LABEL} AS label FROM (SELECT campaign_key, anchor AS key, regexp_extract(anchor, '\\|(.*)$', 1) AS v FROM clusters)",
    "d_anomalies": _anomalies("SELECT * FROM found"),
    "d_evidence": _anomalies("SELECT * FROM behind"),
    "d4_anomaly_rows": _anomalies("SELECT anomaly_key, observed AS score, CAST(greatest(1, least(5, observed)) AS INTEGER) AS severity, anomaly_type || ': observed ' || CAST(observed AS BIGINT) || ', threshold ' || CAST(threshold AS BIGINT) AS reason, document_count FROM found"),
    "w10_anomaly_order": _anomalies("""SELECT anomaly_key, row_number() OVER (ORDER BY CASE anomaly_type WHEN 'high_severity' THEN 1 WHEN 'repeated_indicator' THEN 2 ELSE 3 END, coalesce(d, []), coalesce(i, []), anomaly_key) AS place FROM found
        LEFT JOIN (SELECT anomaly_key, list(document_id ORDER BY document_id) FILTER (document_id IS NOT NULL) AS d, list(indicator_key ORDER BY indicator_key) FILTER (indicator_key IS NOT NULL) AS i FROM behind GROUP BY 1) USING (anomaly_key)"""),
    "e10_images": """SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR length(trim(coalesce(text, ''))) < 400 OR regexp_matches(lower(text), 'lừa|scam|chuyển khoản|tài khoản|qr|mất tiền|giả mạo|phishing|số điện thoại|biên lai') THEN array_to_string(list_distinct_two, ',') ELSE '' END AS images, true AS needed
        FROM (SELECT *, CASE WHEN source = lang THEN [source, 'third'] ELSE [source, lang] END AS list_distinct_two FROM documents)""",
    "f5_bank_registry": _with(*_GRAPH) + f""" SELECT campaign_key, split_part(key, '|', 1) AS anchor_kind, {_MASK} AS masked_anchor, {_LABEL} AS label, status, risk_score, document_count,
        CASE WHEN maximum_severity >= 5 THEN 'critical' WHEN maximum_severity = 4 THEN 'high' WHEN maximum_severity = 3 THEN 'medium' ELSE 'low' END AS band,
        CASE WHEN status <> 'confirmed' AND risk_score >= 5 OR status = 'confirmed' AND maximum_severity >= 5 THEN 'URGENT' ELSE 'REVIEW' END AS priority,
        CASE WHEN status <> 'confirmed' THEN 'Confirm the strongest campaign link' WHEN maximum_severity >= 5 THEN 'Escalate this confirmed high-severity campaign' ELSE 'Review the newest linked evidence' END AS title,
        CASE WHEN status <> 'confirmed' THEN document_count || ' source documents and ' || (SELECT count(*) FROM keys WHERE component = c.component) || ' exact indicators are linked, but an analyst has not confirmed this campaign yet.'
             WHEN maximum_severity >= 5 THEN 'The campaign is analyst-confirmed, reaches severity level ' || maximum_severity || ', and was last observed ' || strftime(last_seen, '%Y-%m-%d %H:%M') || '.'
             ELSE document_count || ' source documents currently support this active campaign.' END AS reason,
        CASE WHEN status = 'confirmed' AND maximum_severity >= 5 THEN 'Fraud Operations' ELSE 'Fraud Analysis' END AS owner
        FROM (SELECT *, anchor AS key, regexp_extract(anchor, '\\|(.*)$', 1) AS v FROM registry WHERE status <> 'dismissed') c""",
    "e9_bundle": "SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(least(length(text), 12000) AS INTEGER) AS chars, CAST(least(10, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s\\x{00A0}\\x{3000}]')))) AS INTEGER) AS n_comments, 1 AS n_media, length(text) < 400 AS needed FROM documents",
    "f1_eligible": _with(_CASES) + " SELECT document_id, category, severity, confidence FROM docs WHERE category IN ('scam_report', 'impersonation_abuse') AND confidence >= 0.6 AND specific_case",
    "v1_validated": _with(_CASES) + " SELECT document_id, concat_ws(',', CASE WHEN severity NOT BETWEEN 1 AND 5 THEN 'severity' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN first_seen > last_seen THEN 'times' END) AS violations FROM docs WHERE severity NOT BETWEEN 1 AND 5 OR confidence NOT BETWEEN 0 AND 1 OR first_seen > last_seen",
    "v3_sound_clusters": _with(*_GRAPH) + " SELECT campaign_key, document_count >= 2 AND NOT EXISTS (SELECT 1 FROM docs JOIN components USING (document_id) WHERE component = c.component AND category NOT IN ('scam_report', 'impersonation_abuse')) AS sound FROM clusters c",
    "v6_reconciled": _with(*_GRAPH) + " SELECT (SELECT count(*) FROM docs) AS document_count, count(*) AS active_campaigns, CAST(count_if(risk_score >= 5) AS BIGINT) AS high_risk_campaigns, CAST(coalesce(sum(document_count), 0) AS BIGINT) AS evidence_documents, true AS reconciled FROM registry WHERE status <> 'dismissed'",
    "j1_analytics_input": _with(_CASES) + " SELECT document_id, strftime(coalesce(p, first_seen), '%Y-%m-%d') AS first_seen, strftime(coalesce(p, first_seen), '%Y-%m-%d') AS last_seen, CAST((SELECT count(*) FROM edges WHERE edges.document_id = d.document_id) AS INTEGER) AS n FROM (SELECT *, CASE WHEN severity = 3 THEN first_seen + INTERVAL 1 DAY END AS p FROM docs WHERE severity > 0) d",
    "j3_exact_matches": _with(*_GRAPH, _MATCH) + " SELECT input_id, campaign_key, match_score, anchor_match, CAST(n_reasons AS INTEGER) AS n_reasons FROM matches",
    "w2_best_campaign": _with(*_GRAPH, _MATCH) + " SELECT * EXCLUDE (confirmed) FROM checks",
    "f13_recommended": _with(*_GRAPH, _MATCH) + """ SELECT status, CAST(step AS INTEGER) AS step, action, count(*) AS n FROM (
        SELECT status, 1 AS step, CASE status WHEN 'matched_campaign' THEN 'Pause the transfer and do not follow instructions in the submitted evidence.' WHEN 'possible_match' THEN 'Pause the transfer while the possible campaign match is reviewed.'
          WHEN 'new_unmatched_case' THEN 'Do not proceed until the recipient and request are independently verified.' ELSE 'No concrete scam case was identified in this submission.' END AS action FROM checks
        UNION ALL SELECT status, 2, CASE status WHEN 'matched_campaign' THEN CASE WHEN confirmed THEN 'Review the confirmed campaign evidence before taking bank action.' ELSE 'Treat this as a possible campaign match until an analyst confirms it.' END
          WHEN 'possible_match' THEN 'Verify the recipient through an independent official channel.' WHEN 'new_unmatched_case' THEN 'Share the evidence anonymously so analysts can assess a new campaign.'
          ELSE 'If money or credentials are requested, verify through an official channel before proceeding.' END FROM checks
        UNION ALL SELECT status, 3, CASE status WHEN 'matched_campaign' THEN 'Verify the recipient through the bank''s official app, website, or card number.' WHEN 'possible_match' THEN 'Share the evidence anonymously if this is a concrete attempt.'
          ELSE 'Do not install apps, reveal OTPs, or pay an advance fee.' END FROM checks WHERE status <> 'not_scam'
        ) GROUP BY ALL""",
    "j9_campaign_evidence": _with(*_GRAPH) + " SELECT campaign_key, document_id, membership_score, CASE WHEN severity > 1 THEN 'Case ' || document_id ELSE 'Untitled document' END AS title FROM (SELECT *, row_number() OVER (PARTITION BY campaign_key ORDER BY membership_score DESC, document_id) AS r FROM members) JOIN docs USING (document_id) WHERE r <= 3",
    "j12_without_source": _with(*_GRAPH) + " SELECT campaign_key, document_count FROM clusters WHERE document_count <= 2",
    "j17_grounded_insights": _with(_CASES) + " SELECT 'About ' || document_id AS title, least(5, greatest(1, severity + 3)) AS severity, least(1, confidence + 0.5) AS confidence, document_id AS evidence_ids, 'https://x.example/' || document_id AS evidence_urls, sha256('About ' || document_id || '|' || document_id) AS insight_key FROM docs",
    "a1_summary": _with(_CASES) + " SELECT count(*) AS document_count, round(avg(confidence), 6) AS average_confidence, max(severity) AS maximum_severity, (SELECT count(DISTINCT key) FROM edges) AS unique_indicator_count, (SELECT count(*) FROM edges) AS document_indicator_edge_count, " + _digest("document_id") + " AS ids, (SELECT " + _digest("key") + " FROM (SELECT DISTINCT key FROM edges)) AS keys FROM docs",
    "a1_evidence": _with(_CASES) + " SELECT 'summary' AS metric_scope, 'global' AS metric_key, document_id FROM docs UNION SELECT 'category', category, document_id FROM docs UNION SELECT 'severity', CAST(severity AS VARCHAR), document_id FROM docs UNION SELECT 'indicator', key, document_id FROM edges SEMI JOIN docs USING (document_id)",
    "a2_by_category": _with(_CASES) + " SELECT category, count(*) AS document_count, round(avg(confidence), 6) AS average_confidence, max(severity) AS maximum_severity, " + _digest("document_id") + " AS evidence_document_ids, round(count(*) / (SELECT count(*) FROM docs), 6) AS document_share FROM docs GROUP BY 1",
    "a3_by_severity": _with(_CASES) + " SELECT severity, count(*) AS document_count, round(avg(confidence), 6) AS average_confidence, " + _digest("document_id") + " AS evidence_document_ids, round(count(*) / (SELECT count(*) FROM docs), 6) AS document_share FROM docs GROUP BY 1",
    "a4_by_indicator": _with(_CASES) + " SELECT * FROM (SELECT key, count(DISTINCT document_id) AS document_count, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, round(avg(d.confidence), 6) AS average_confidence, max(severity) AS maximum_severity, arg_max(display_value, document_id) AS display_value FROM edges e JOIN docs d USING (document_id) GROUP BY 1) JOIN " + _listed("edges SEMI JOIN docs USING (document_id)", "key", "document_id", "evidence_document_ids") + " USING (key)",
    "a12_evidence_cards": _with(_CASES) + " SELECT key, count(DISTINCT document_id) AS document_count, count(DISTINCT CAST(document_id AS BIGINT) % 10) AS source_count, max(severity) AS maximum_severity, round(avg(d.confidence), 4) AS average_confidence, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, string_agg(DISTINCT scam_type, ',' ORDER BY scam_type) AS scam_types, strftime(min(least(first_seen, last_seen)), '%Y-%m-%d') AS first_seen FROM edges e JOIN docs d USING (document_id) WHERE category IN ('scam_report', 'impersonation_abuse') AND d.confidence >= 0.6 AND specific_case GROUP BY 1",
    "a16_job_counts": "WITH " + _EVENTS + " SELECT job_id, count(*) AS discovered, count(DISTINCT url_key) AS deduplicated, CAST(count_if(event_id % 4 = 0) AS BIGINT) AS fetched, CAST(count_if(event_id % 4 = 1) AS BIGINT) AS classified, CAST(count_if(event_id % 4 = 2) AS BIGINT) AS failed FROM e GROUP BY 1",
    "a17_usage": "WITH " + _EVENTS + " SELECT job_id, 'search' AS provider, trim(regexp_replace(lower(event_type), '[^a-z0-9]+', '_', 'g'), '_') AS operation, count(*) AS calls, CAST(sum(length(url_key)) AS BIGINT) AS tokens, round(sum(floor(value)), 2) AS seconds FROM e GROUP BY 1, 2, 3",
    "w7_newest_sources": _with(_CASES) + " SELECT key, url, document_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY last_seen DESC, url) AS k FROM (SELECT *, row_number() OVER (PARTITION BY key, url ORDER BY last_seen DESC, document_id) AS r FROM (SELECT key, document_id, 'u' || (CAST(document_id AS BIGINT) % 10) AS url, last_seen FROM edges JOIN docs USING (document_id))) WHERE r = 1) WHERE k <= 3",
    "g1_components": _with(_CASES, _components("edges")) + " SELECT * FROM components",
    "g1_eligible_components": _with(_CASES, "chosen AS (SELECT edges.* FROM edges JOIN docs d USING (document_id) WHERE category IN ('scam_report', 'impersonation_abuse') AND d.confidence >= 0.6 AND specific_case)", _components("chosen")) + " SELECT * FROM components",
    "g1_page_components": _with(f"hosts AS (SELECT CAST(page_id AS VARCHAR) AS document_id, {_HOST} AS key FROM pages)", _components("hosts")) + " SELECT * FROM components",
    "g1_line_components": _with("lines AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS document_id, md5(trim(line, ' ')) AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line, ' ')) >= 24)", _components("lines")) + " SELECT * FROM components",
    "a6_clusters": _with(*_GRAPH) + """ SELECT component, campaign_key, anchor, document_count, (SELECT CAST(sum(n) AS BIGINT) FROM keys WHERE component = c.component) AS edge_count, maximum_severity, average_confidence, risk_score,
        (SELECT count(*) FROM keys WHERE component = c.component) AS indicator_count, (SELECT count(*) FROM shared WHERE component = c.component) AS shared_count, part, shared_keys, scam_types, bank_roles,
        (SELECT string_agg(category || ':' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM docs JOIN components x USING (document_id) WHERE x.component = c.component GROUP BY 1)) AS category_counts,
        strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM clusters c JOIN """ + _listed("shared", "component", "key", "shared_keys") + " USING (component)",
    "a6_cluster_keys": _with(*_GRAPH) + " SELECT component, campaign_key, k.key, n, CASE WHEN k.key = anchor THEN 'anchor' WHEN n > 1 THEN 'shared' ELSE 'supporting' END AS role FROM keys k JOIN anchors USING (component)",
    "g3_memberships": _with(*_GRAPH) + """ SELECT campaign_key, document_id, membership_score, reasons FROM members
        JOIN (SELECT component, document_id, string_agg(key || ':' || printf('%.4f', contribution), ',' ORDER BY key) AS reasons FROM reasons GROUP BY 1, 2) USING (component, document_id)""",
    "g3_reasons": _with(*_GRAPH) + " SELECT campaign_key, document_id, 'shared_strong_indicator' AS reason_type, key AS indicator_key, kind AS indicator_type, n AS shared_document_count, w AS strength, confidence AS indicator_confidence, contribution, 'lineitem' AS evidence_source, quote AS evidence_quote FROM reasons JOIN anchors USING (component)",
    "a11_indicator_roles": _with(*_GRAPH) + " SELECT campaign_key, r.key, role, weight, coalesce(said, '') AS reasons FROM roles r LEFT JOIN (SELECT campaign_key, key, string_agg(quote, ',' ORDER BY quote) AS said FROM (SELECT *, row_number() OVER (PARTITION BY campaign_key, key ORDER BY quote) AS k FROM (SELECT DISTINCT campaign_key, key, quote FROM reasons JOIN anchors USING (component))) WHERE k <= 12 GROUP BY 1, 2) USING (campaign_key, key)",
    "a6_line_clusters": _with(*_LINE_GRAPH) + " SELECT component, campaign_key, anchor, document_count, (SELECT CAST(sum(n) AS BIGINT) FROM keys WHERE component = c.component) AS edge_count, (SELECT count(*) FROM keys WHERE component = c.component) AS indicator_count, (SELECT count(*) FROM shared WHERE component = c.component) AS shared_count, maximum_severity, average_confidence, risk_score FROM clusters c",
    "g3_line_memberships": _with(*_LINE_GRAPH) + " SELECT campaign_key, document_id, membership_score FROM members",
    "d_line_anomalies": _anomalies("SELECT anomaly_type, anomaly_key, observed, document_count FROM found", _LINE_CASES),
    "j3_line_matches": _with(*_LINE_GRAPH, _MATCH) + " SELECT input_id, campaign_key, match_score, anchor_match, CAST(n_reasons AS INTEGER) AS n_reasons FROM matches",
    "t4_event_components": _with("acts AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS document_id, event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS key FROM events)", _components("acts")) + " SELECT * FROM components",
    "t2_lookback": "WITH " + _EVENTS + """, seen AS (SELECT ts, url_key, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM e), ends AS (SELECT url_key, b + INTERVAL 15 MINUTE AS cycle_end FROM seen UNION ALL SELECT url_key, b + INTERVAL 30 MINUTE FROM seen WHERE ts >= b + INTERVAL 10 MINUTE)
        SELECT strftime(cycle_end - INTERVAL 20 MINUTE, '%Y-%m-%d %H:%M:%S') AS cycle_start, strftime(cycle_end, '%Y-%m-%d %H:%M:%S') AS cycle_end, url_key, count(*) AS hits FROM ends GROUP BY 1, 2, 3""",
    "f14_document_table": _with(_CASES) + """ SELECT document_id, strftime(first_seen, '%Y-%m-%d %H:%M:%S') || ' UTC' AS captured, CASE WHEN i % 3 = 0 THEN '—' ELSE 'web' END AS platform, '—' AS author,
        CASE WHEN i % 2 = 1 THEN 'order ' || document_id WHEN length(body) > 180 THEN left(body, 179) || '…' ELSE body END AS content, CASE WHEN i % 7 = 0 THEN '—' ELSE category END AS category, confidence,
        CASE WHEN i % 7 <> 0 THEN CAST(severity AS DOUBLE) END AS severity, coalesce(CASE WHEN length(marks) > 300 THEN left(marks, 299) || '…' ELSE marks END, '—') AS indicators, CASE WHEN i % 5 = 0 THEN 'Yes' ELSE 'No' END AS agent,
        coalesce(states, '—') AS vision, '' AS source
        FROM (SELECT *, CAST(document_id AS BIGINT) AS i, trim(repeat('case ' || document_id || ' ', 30)) AS body FROM docs)
        LEFT JOIN (SELECT document_id, string_agg(kind || ': ' || display_value, ', ' ORDER BY n, kind || ': ' || display_value) AS marks, string_agg(DISTINCT CASE WHEN n < 5 AND n % 3 = 0 THEN 'read' WHEN n < 5 AND n % 3 = 1 THEN 'pending' END, ', ' ORDER BY CASE WHEN n < 5 AND n % 3 = 0 THEN 'read' WHEN n < 5 AND n % 3 = 1 THEN 'pending' END) AS states
          FROM (SELECT *, CAST(split_part(quote, ' ', 2) AS INTEGER) AS n FROM edges) GROUP BY 1) USING (document_id)""",
    "f14_event_table": "WITH " + _EVENTS + """ SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS time, CASE WHEN event_id % 4 = 0 THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN event_id % 3 = 0 THEN '—' ELSE job_id END AS stage,
        CASE WHEN length(m) > 400 THEN left(m, 399) || '…' ELSE m END AS message, '{"url_key":"' || url_key || '","job_id":"' || job_id || '"}' AS details FROM (SELECT *, trim(repeat(event_type || ' ', 60)) AS m FROM e)""",
    "f14_job_table": "WITH " + _EVENTS + """ SELECT CASE WHEN job_id LIKE '%7' THEN 'Untitled' ELSE job_id END AS job, '—' AS mode, '—' AS status, 'classify' AS stage, count(*) AS discovered, CAST(count_if(event_id % 4 = 0) AS BIGINT) AS fetched,
        CAST(0 AS BIGINT) AS agent, CAST(0 AS BIGINT) AS classified, CAST(0 AS BIGINT) AS failed, strftime(max(ts), '%Y-%m-%d %H:%M:%S') || ' UTC' AS updated FROM e GROUP BY job_id""",
    "f14_cluster_table": _with(*_GRAPH) + """ SELECT campaign_key AS cluster, risk_score AS risk, document_count AS documents, maximum_severity, (SELECT count(*) FROM shared WHERE component = c.component) AS shared_indicators, replace(scam_types, ',', ', ') AS scam_types,
        strftime(last_seen, '%Y-%m-%d') AS updated FROM clusters c""",
    "f14_previews": """SELECT CAST(doc_id AS VARCHAR) AS document_id, coalesce(left(text, 160), '') AS preview, coalesce(indicators, '') AS indicators FROM documents LEFT JOIN (SELECT page_id, 'domain|' || """ + _HOST + """ AS indicators FROM pages) ON page_id = doc_id""",
    "f16_member_reasons": _with(*_GRAPH) + """ SELECT campaign_key, document_id, string_agg(label, ' / ' ORDER BY first, label) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY campaign_key, document_id ORDER BY first, label) AS r
        FROM (SELECT campaign_key, document_id, 'Exact indicator shared across ' || n || ' sources' AS label, min(key) AS first FROM reasons JOIN anchors USING (component) GROUP BY 1, 2, 3)) WHERE r <= 4 GROUP BY 1, 2""",
    "e3_payloads": "SELECT o_orderkey, o_orderkey % 5 <> 0 AS valid, CASE WHEN o_orderkey % 5 <> 0 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS account, CASE WHEN o_orderkey % 5 <> 0 THEN 'ORDER' || o_orderkey END AS reference FROM orders",
    "n23_public_texts": "SELECT page_id, left(trim(regexp_replace(replace(url, '/', ' '), '\\s+', ' ', 'g')), 24) AS shown FROM pages",
    "n18_bounds": "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 30 THEN CAST(p_size AS DOUBLE) END AS size, CAST(least(30, greatest(10, p_size)) AS DOUBLE) AS clamped FROM part",
    "e2_addresses": f"SELECT page_id AS input_id, 'domain' AS kind, {_HOST} AS value FROM pages",
    "v2_repeated_ids": "SELECT coalesce(CAST(k AS VARCHAR), '') AS l_orderkey, count(*) AS n FROM (SELECT CASE WHEN l_linenumber < 7 THEN l_orderkey END AS k FROM lineitem) GROUP BY 1 HAVING n > 1 OR l_orderkey = ''",
    "v4_guarded": _with(*_GRAPH) + " SELECT campaign_key, document_id FROM members JOIN docs d USING (document_id) WHERE specific_case AND category IN ('scam_report', 'impersonation_abuse') AND d.confidence >= 0.6",
    "v5_campaigns": _with(*_GRAPH) + " SELECT campaign_key, 'confirmed' AS violations FROM registry WHERE status = 'confirmed' AND document_count <= 2",
    "w8_first_candidates": _with(_CASES) + " SELECT e.document_id || '/' || key AS lookup_id, kind, split_part(key, '|', 2) AS value FROM edges e WHERE key IN (SELECT key FROM edges WHERE CAST(split_part(quote, ' ', 2) AS INTEGER) > 1)",
    "g6_graph": _with(*_GRAPH, _NODES_LINKS) + " SELECT id, label, type, size, status, NULL AS target FROM nodes UNION ALL SELECT source, NULL, relation, weight, status, target FROM links",
    "g7_filtered_graph": _with(*_GRAPH, _NODES_LINKS) + ", shown AS (SELECT * FROM nodes WHERE type IN ('campaign', 'tactic')) SELECT id, label, type, size, status, NULL AS target FROM shown UNION ALL SELECT source, NULL, relation, weight, status, target FROM links WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)",
    "g8_neighbourhood": _with(*_GRAPH, _NODES_LINKS) + " SELECT source AS id FROM links WHERE 'tactic-1-urgent' IN (source, target) UNION SELECT target FROM links WHERE 'tactic-1-urgent' IN (source, target)",
    "f9_taxonomy": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Credential theft' WHEN 1 THEN 'Vietcombank' WHEN 2 THEN 'Odd Brand' || substr(p_brand, 6) END AS label, CASE p_partkey % 4 WHEN 0 THEN 'tactic' WHEN 1 THEN 'bank' WHEN 2 THEN 'tactic' END AS type,
        CASE p_partkey % 4 WHEN 0 THEN 'tactic-credential-theft' WHEN 1 THEN 'bank-vietcombank' WHEN 2 THEN 'tactic-odd-brand' || regexp_replace(lower(substr(p_brand, 6)), '[^a-z0-9]+', '-', 'g') ELSE '' END AS id FROM part""",
    "f12_result_copy": _with(*_GRAPH, _MATCH) + """ SELECT input_id, split_part(c, '|', 1) AS kicker, split_part(c, '|', 2) AS heading, split_part(c, '|', 3) AS context, split_part(c, '|', 4) AS match FROM (
        SELECT input_id, CASE WHEN status = 'matched_campaign' AND confirmed THEN 'KNOWN CAMPAIGN|Pause this transfer.|CONFIRMED CAMPAIGN MATCH|ANALYST CONFIRMED'
          WHEN status = 'possible_match' AND match_score < 0.7 THEN 'LIKELY RELATED CAMPAIGN|Pause this transfer.|ASSISTED CAMPAIGN RELATIONSHIP|' || CAST(floor(match_score * 100 + 0.5) AS INTEGER) || '% RELATIONSHIP CONFIDENCE'
          WHEN status IN ('matched_campaign', 'possible_match') THEN 'POSSIBLE CAMPAIGN MATCH|Pause this transfer.|UNCONFIRMED CAMPAIGN EVIDENCE|' || CAST(floor(match_score * 100 + 0.5) AS INTEGER) || '% MATCH SCORE'
          WHEN status = 'new_unmatched_case' THEN 'NEW UNMATCHED CASE|Treat this as suspicious.|NO CAMPAIGN ASSIGNED|NEW CASE' ELSE 'NO CONCRETE SCAM CASE|No scam case detected.|CONSERVATIVE ANALYSIS|NOT A SPECIFIC CASE' END AS c FROM checks)""",
    "f12_impact": _with(*_GRAPH, _MATCH) + """, told AS (SELECT k.input_id, k.status, c.component IS NOT NULL AS has, c.document_count, (SELECT count(*) FROM keys WHERE component = c.component) AS n, c.maximum_severity, c.risk_score, c.first_seen, d.category, d.severity, d.confidence,
          (SELECT count(*) FROM edges WHERE document_id = k.input_id) AS e FROM checks k JOIN docs d ON d.document_id = k.input_id LEFT JOIN clusters c USING (campaign_key))
        SELECT input_id, 1 AS place, CASE WHEN has THEN CAST(document_count AS VARCHAR) WHEN status = 'not_scam' THEN upper(replace(category, '_', ' ')) ELSE 'NEW' END AS value, CASE WHEN has THEN 'CAMPAIGN DOCUMENTS' WHEN status = 'not_scam' THEN 'CLASSIFICATION' ELSE 'CASE STATUS' END AS label FROM told
        UNION ALL SELECT input_id, 2, CASE WHEN has THEN CAST(n AS VARCHAR) ELSE severity || '/5' END, CASE WHEN has THEN 'TOTAL CAMPAIGN SIGNALS' ELSE 'SEVERITY' END FROM told
        UNION ALL SELECT input_id, 3, CASE WHEN has THEN maximum_severity || '/5' ELSE CAST(floor(confidence * 100 + 0.5) AS INTEGER) || '%' END, CASE WHEN has THEN 'MAX SEVERITY' ELSE 'ANALYSIS CONF.' END FROM told
        UNION ALL SELECT input_id, 4, CASE WHEN has THEN printf('%.1f', risk_score) ELSE CAST(e AS VARCHAR) END, CASE WHEN has THEN 'RISK SCORE' ELSE 'STRONG INDICATORS' END FROM told
        UNION ALL SELECT input_id, 5, CASE WHEN has THEN upper(strftime(first_seen, '%d %b %Y')) ELSE 'NOW' END, CASE WHEN has THEN 'FIRST OBSERVED' ELSE 'ANALYZED' END FROM told""",
    "s5_store": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 400000 THEN 0.0::DOUBLE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 OR o_totalprice > 400000",
    "w5_masked_indicators": _with(*_GRAPH) + f" SELECT campaign_key, role, {_SHOWN} AS display_value FROM (SELECT *, regexp_extract(key, '\\|(.*)$', 1) AS v, row_number() OVER (PARTITION BY campaign_key ORDER BY role, weight DESC, key) AS r FROM roles) WHERE r <= 24",
    "f7_by_tactic": _with(*_GRAPH) + " SELECT campaign_key FROM clusters WHERE scam_types LIKE '%urgent%' OR bank_roles LIKE '%building%'",
    "w9_best_cluster": _with(*_GRAPH) + " SELECT lookup_id, campaign_key, matched FROM (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY matched DESC, risk_score DESC, campaign_key) AS r FROM (SELECT key AS lookup_id, m.campaign_key, risk_score, count(DISTINCT document_id) AS matched FROM edges JOIN members m USING (document_id) JOIN registry g ON g.campaign_key = m.campaign_key AND g.status <> 'dismissed' GROUP BY ALL)) WHERE r = 1",
    "c1_windows": """WITH ranges AS (SELECT CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 75 AS e FROM orders),
        months AS (SELECT s, e, CAST(unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS DATE) AS month FROM ranges),
        clipped AS (SELECT month, greatest(s, month) AS a, least(e, last_day(month)) AS b FROM months),
        weeks AS (SELECT month, b, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS w FROM clipped)
        SELECT strftime(month, '%Y-%m-%d') AS month, count(*) AS n_weeks, CAST(sum(least(b, w + 6) - w + 1) AS BIGINT) AS days FROM weeks GROUP BY 1""",
    "c2_missing_cells": "WITH " + _EVENTS + """, d AS (SELECT job_id, event_type, CAST(ts AS DATE) AS day FROM e), seen AS (SELECT DISTINCT * FROM d WHERE event_type <> 'click' OR day(day) > 3)
        SELECT job_id, event_type, strftime(day, '%Y-%m-%d') AS day FROM (SELECT j.job_id, t.event_type, x.day FROM (SELECT DISTINCT job_id FROM d) j, (SELECT DISTINCT event_type FROM d) t, (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d) x EXCEPT SELECT job_id, event_type, day FROM seen)""",
    "c3_drilled": "WITH " + _EVENTS + """, d AS (SELECT job_id, event_type, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(date_trunc('month', ts) AS DATE) + CAST(floor((day(ts) - 1) / 7) AS INTEGER) * 7 AS week_start FROM e), m AS (SELECT job_id, event_type, month, count(*) AS n FROM d GROUP BY 1, 2, 3)
        SELECT job_id, event_type, strftime(month, '%Y-%m-%d') AS month, NULL AS week_start, n FROM m UNION ALL SELECT job_id, event_type, strftime(month, '%Y-%m-%d'), strftime(week_start, '%Y-%m-%d'), count(*) FROM d WHERE (job_id, event_type, month) IN (SELECT (job_id, event_type, month) FROM m WHERE n >= 10) GROUP BY 1, 2, 3, 4""",
    "c4_registry": "WITH " + _EVENTS + " SELECT url_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS hits FROM e GROUP BY 1",
    "t1_cycles": "WITH " + _EVENTS + " SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS cycle_start, job_id, count(*) AS hits FROM e GROUP BY 1, 2",
    "t3_fresh_hits": "WITH " + _EVENTS + " SELECT event_id, url_key FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY ts, event_id) AS r FROM e WHERE day(ts) > 20) WHERE r = 1 AND url_key NOT IN (SELECT url_key FROM e WHERE day(ts) <= 20)",
    "t5_first_last": "WITH " + _EVENTS + " SELECT url_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS hits FROM e GROUP BY 1",
    "f6_selection": _with(_CASES) + " SELECT document_id FROM docs WHERE severity > 0 AND category IN ('noise', 'news_pr') AND specific_case AND first_seen BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31' ORDER BY first_seen DESC, document_id LIMIT 200",
    "f16_reasons": _with(_CASES) + """ SELECT document_id, left(scam_type, 8) || ',shared,anchor' AS short,
        'Exact indicator shared across ' || CASE WHEN severity > 1 THEN severity || ' ' ELSE '' END || 'sources / Matches the campaign anchor indicator / Linked by stored campaign evidence' AS shown FROM docs""",
    "j10_profiles": _with(*_GRAPH) + " SELECT campaign_key, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM (SELECT m.*, row_number() OVER (PARTITION BY m.campaign_key ORDER BY membership_score DESC, m.document_id) AS r FROM members m JOIN docs d ON d.document_id = m.document_id AND severity >= 2) WHERE r <= 2 GROUP BY 1",
    "j14_media_findings": "SELECT o_orderkey AS document_id, o_orderstatus AS url, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 'read' WHEN o_orderkey % 4 = 0 THEN 'kept' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN o_orderpriority END AS note FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0",
    "j15_resolved": _with(_CASES) + " SELECT key, count(*) AS n, CAST(count_if(kind = 'email') AS BIGINT) AS missing FROM edges GROUP BY 1",
    "n20_taxonomy": "SELECT p_partkey, CASE WHEN a = b THEN a ELSE a || ',' || b END AS labels FROM (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS a, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS b FROM part)",
    "n21_timestamps": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN d || ' 05:06:07' WHEN 1 THEN d || ' 00:00:00' WHEN 3 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') || ' 23:00:00' END AS at FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)",
    "w12_newest_job": "WITH " + _EVENTS + " SELECT job_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1",
    "w13_label_union": "SELECT p_size, label FROM (SELECT p_size, label, row_number() OVER (PARTITION BY p_size, lower(label) ORDER BY p_partkey) AS r FROM (SELECT p_size, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS label FROM part)) WHERE r = 1",
}
ORACLES["t4_line_components"] = ORACLES["g1_line_components"]
