"""DuckDB SQL for the queries that SQL can express."""

QUALITY = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM docs
), runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS found
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM words WHERE len(w) >= 8)
), covered AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS word FROM runs WHERE found > 1) GROUP BY doc_id
), measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered c USING (doc_id)
), failing AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines AS soft_failed
  FROM measured
), hosts AS (
  SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR soft_failed THEN 1 ELSE 0 END) AS f FROM failing GROUP BY source
), sums AS (
  SELECT CAST(sum(f) AS DOUBLE) / sum(n) AS m, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n * n) AS DOUBLE) AS squares, count(*) - 1 AS k, sum(CAST(f AS DOUBLE) * f / n) AS own FROM hosts
), prior AS (
  SELECT m, CASE WHEN share > 0 THEN greatest(1.0, 1 / share - 1) END AS s
  FROM (SELECT m, CASE WHEN m > 0 AND m < 1 AND total - squares / total - k <> 0 THEN ((own - total * m * m) / (m * (1 - m)) - k) / (total - squares / total - k) END AS share FROM sums)
), verdicts AS (
  SELECT source, coalesce(rate - m > 3.0 * sqrt(rate * (1 - rate) / (n + s + 1)), false) AS rejected
  FROM (SELECT source, n, m, s, (f + m * s) / (n + s) AS rate FROM hosts, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (soft_failed AND rejected) AS kept
FROM failing f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach AS (
  SELECT a AS doc_id, a AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
), least AS (
  SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(component, doc_id) AS BIGINT) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id, lower(trim(coalesce(url, ''))) AS u FROM pages
), parsed AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(u, '^[a-z][a-z0-9+.-]*://', ''), '^(?:[^/?#@]*@)?([^/?#:@]*)', 1), '^www\.', ''), '\.$', '') AS host,
         regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*/([^/?#]+)', 1) AS head
  FROM parts
), captures AS (
  SELECT page_id, host, head, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (page_id % 366) AS fetched_at FROM parsed
), hosts AS (SELECT host AS pattern, min(page_id) AS p FROM parsed WHERE host <> '' GROUP BY 1
), domains AS (SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS pattern, min(page_id) AS p FROM parsed GROUP BY 1 HAVING pattern <> ''
), heads AS (SELECT host || '/' || head AS pattern, min(page_id) AS p FROM parsed WHERE head <> '' GROUP BY 1
), held AS (
  SELECT 'hosts' AS list_name, pattern, 'block' AS action, 2 AS strength, p % 180 AS d, CASE WHEN p % 3 = 0 THEN p % 180 + 120 ELSE 100000 END AS e FROM hosts
  UNION ALL SELECT 'domains', pattern, 'review', 3, p % 90 + 100, 100000 FROM domains
  UNION ALL SELECT 'paths', pattern, 'allow', 1, p % 200, p % 200 + 60 FROM heads
), asked AS (
  SELECT page_id, 0 AS depth, host || '/' || head AS pattern FROM captures WHERE head <> '' AND host <> ''
  UNION ALL
  SELECT page_id, CASE WHEN head <> '' THEN i ELSE i - 1 END, array_to_string(l[i:], '.')
  FROM (SELECT page_id, head, string_split(host, '.') AS l, unnest(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))) AS i FROM captures WHERE host <> '')
), active AS (
  SELECT a.page_id, h.*, row_number() OVER (PARTITION BY a.page_id ORDER BY depth, strength, list_name, h.pattern) AS k
  FROM asked a JOIN captures c USING (page_id) JOIN held h ON a.pattern = h.pattern
  WHERE c.fetched_at >= TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * h.d AND c.fetched_at < TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * h.e
)
SELECT c.page_id, strftime(c.fetched_at, '%Y-%m-%d') AS fetched_at, c.host, coalesce(a.action, 'none') AS verdict, a.pattern, a.list_name,
       strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * a.d, '%Y-%m-%d') AS valid_from
FROM captures c LEFT JOIN active a ON a.page_id = c.page_id AND a.k = 1
"""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= 5
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS (
  SELECT r, i, p.n, item_id FROM places p JOIN windows x ON x.n = p.n AND x.s = array_to_string(w[i:i + p.n - 1], ' ')
), covered AS (
  SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS word FROM hits) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

LEXICAL_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), sums AS (
  SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0
), counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM sums) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM benchmark) GROUP BY 1, 2
), norms AS (
  SELECT r, doc_id, 75 + (25 * len(w) * docs) // terms AS m FROM d, sums WHERE len(w) > 0
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN norms USING (r) GROUP BY 1, 2, 3
)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scored WHERE score > 0) WHERE k <= 20
"""

HARD_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same) WHERE r <= 5
), ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE r <= 5
"""

ORACLES = {
    "op1_quality_rules": QUALITY,
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op4_url_filters": URL_FILTERS,
    "op7_exact_top_k": TOP_K,
    "op11_decontamination": DECONTAMINATION,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_hard_negatives": HARD_NEGATIVES,
}
