"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

EXACT = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id)
"""

URLS = r"""
WITH c AS (
  SELECT page_id, DATE '2024-01-01' + (page_id % 365)::INT AS fetched_at,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '\.$', '') AS host
  FROM pages
), h AS (
  SELECT DISTINCT host, md5(host) AS m FROM c WHERE host <> ''
), e AS (
  SELECT host AS pattern, m, DATE '2024-01-01' + ('0x' || m[3:4])::INT AS day, CASE WHEN m[5:5] < '8' THEN 'spam' ELSE 'adult' END AS category
  FROM h WHERE m[1:1] < '4'
), spans AS (
  SELECT pattern, category, day AS a, CASE WHEN m[2:2] < '8' THEN day + 60 END AS b FROM e
  UNION ALL SELECT pattern, category, day + 120, NULL FROM e WHERE m[2:2] < '4'
  UNION ALL
  SELECT pattern, 'domain', DATE '2024-01-01', NULL
  FROM (SELECT DISTINCT CASE WHEN len(string_split(host, '.')) <= 3 THEN host ELSE array_to_string(string_split(host, '.')[-3:], '.') END AS pattern FROM h)
  WHERE md5(pattern)[1:1] = '0'
), hit AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
  FROM c JOIN spans ON (host = pattern OR ends_with(host, '.' || pattern)) AND a <= fetched_at AND (b IS NULL OR fetched_at < b)
  GROUP BY 1
)
SELECT page_id, host, fetched_at::VARCHAR AS fetched_at, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, coalesce(categories, '') AS categories
FROM c LEFT JOIN hit USING (page_id)
"""


def _share(name: str, source: str, parent: str, order: str) -> str:
    """Water-filling of `source` (weight w, capacity, total) within `parent`, as the CTE `name` with `budget`."""
    return f"""
{name}0 AS (SELECT *, capacity / w AS ratio FROM {source}),
{name}1 AS (
  SELECT *, total - coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY ratio, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(w) OVER (PARTITION BY {parent} ORDER BY ratio, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opn
  FROM {name}0),
{name}2 AS (SELECT *, capacity * opn <= lft * w AS ful FROM {name}1),
{name}3 AS (SELECT *, max(CASE WHEN NOT ful THEN lft::DOUBLE / opn END) OVER (PARTITION BY {parent}) AS lvl FROM {name}2),
{name} AS (SELECT * EXCLUDE (w, total, ratio, lft, opn, ful, lvl), least(CASE WHEN ful THEN capacity ELSE floor(coalesce(lvl, 0) * w)::BIGINT END, capacity)::BIGINT AS budget FROM {name}3)"""


MIX = f"""
WITH t AS (
  SELECT doc_id, 'd' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4) AS domain, lang AS language, source AS origin,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n
  FROM documents
), leaf AS (
  SELECT domain, language, origin, sum(n)::BIGINT AS tokens, (2 * sum(n))::BIGINT AS capacity FROM t GROUP BY ALL
), tops AS (
  SELECT 0 AS all_, domain, sum(capacity)::BIGINT AS capacity, CASE domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
         (SELECT floor(sum(n) * 0.5::DOUBLE)::BIGINT FROM t) AS total
  FROM leaf GROUP BY domain
), {_share("a", "tops", "all_", "domain")},
mids AS (
  SELECT leaf.domain, language, sum(leaf.capacity)::BIGINT AS capacity, CASE language WHEN 'en' THEN 4.0 ELSE 2.0 END::DOUBLE AS w, any_value(a.budget) AS total
  FROM leaf JOIN a USING (domain) GROUP BY ALL
), {_share("b", "mids", "domain", "domain, language")},
lows AS (SELECT leaf.*, 1.0::DOUBLE AS w, b.budget AS total FROM leaf JOIN b USING (domain, language)), {_share("c", "lows", "domain, language", "domain, language, origin")},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_, CASE WHEN tokens > 0 THEN budget % tokens ELSE budget END AS rest FROM c),
run AS (
  SELECT t.*, full_, rest, sum(n) OVER (PARTITION BY domain, language, origin ORDER BY md5('7:' || full_ || ':' || doc_id), doc_id::VARCHAR) AS run
  FROM t JOIN plan USING (domain, language, origin)
), uses AS (
  SELECT *, full_ + CASE WHEN full_ < 2 AND run <= rest THEN 1 ELSE 0 END AS uses FROM run
)
SELECT doc_id, domain, language, origin, e::INT AS mix_epoch FROM uses, LATERAL (SELECT unnest(range(0, uses)) AS e) WHERE uses > 0
"""

REVISITS = r"""
WITH u AS (
  SELECT page_id, regexp_replace(url, '#.*$', '') AS bare, md5(coalesce(html, '')) AS tag FROM pages
), v AS (
  SELECT page_id, tag, regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/:?]+)', 1)), '^www\.', '') AS host,
         regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/:?]+)(:[0-9]+)?', '') AS rest
  FROM u
), w AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)(?:ref|source|utm_[a-z]+|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&', '') AS query,
         regexp_replace(regexp_replace(rest, '\?.*$', ''), '/$', '') AS path
  FROM v
), p AS (
  SELECT page_id, tag, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key, page_id * 60 AS t, page_id * 60 + (page_id % 5 + 1) * 86400 AS rt FROM w
), f AS (
  SELECT page_id * 2 AS response_id, url_key, t, tag FROM p WHERE page_id % 13 <> 0
), r AS (
  SELECT page_id, page_id * 2 + 1 AS capture_id, url_key, rt, strftime(TIMESTAMP '2024-01-01' + to_seconds(rt), '%Y-%m-%d') AS day,
         CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'changed' ELSE tag END AS etag
  FROM p
), j AS (
  SELECT r.*, f.response_id, f.tag,
         CASE WHEN f.response_id IS NULL THEN 'missing' WHEN etag IS NULL THEN 'unverified' WHEN etag = f.tag THEN 'resolved' ELSE 'mismatch' END AS state
  FROM r ASOF LEFT JOIN f ON r.url_key = f.url_key AND f.t < r.rt
)
SELECT capture_id, url_key, response_id, state,
       CASE WHEN state IN ('resolved', 'unverified') THEN
         '{' || CASE WHEN etag IS NULL THEN '' ELSE '"cache-control":"max-age=60",' END || '"content-type":"text/html","date":"' || day || '","etag":"' || coalesce(etag, tag) || '"}'
       WHEN etag IS NULL THEN '{"content-type":"message/http","date":"' || day || '"}'
       ELSE '{"cache-control":"max-age=60","date":"' || day || '","etag":"' || etag || '"}' END AS headers
FROM j
"""

TRIE = r"""
WITH t AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (  -- CRC-32 of the id's digits, a bit at a time
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS donor,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 9 AS h
  FROM t
), b AS (
  SELECT c.conv_id, r, turn FROM c JOIN t ON t.conv_id = donor AND r <= h
  UNION ALL SELECT conv_id, r, turn FROM c JOIN t USING (conv_id) WHERE r > h
), s AS (
  SELECT conv_id, coalesce(list(turn ORDER BY r) FILTER (r IS NOT NULL), []) AS turns FROM c LEFT JOIN b USING (conv_id) GROUP BY 1
), p AS (
  SELECT conv_id, d, turns[1:d] AS prefix, d = len(turns) AS ends, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS size
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM s)
), n AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY 1, 2
), k AS (
  SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, prefix)
), u AS (
  SELECT a AS d, prefix[1:a] AS prefix, sum((n_convs - 1) * size) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1, 2
)
SELECT m.conv_id, m.d::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (d, prefix) LEFT JOIN n o ON o.d = m.d - 1 AND o.prefix = m.prefix[1:m.d - 1]
"""

SQL = {
    "op3_url_temporal_join": URLS,
    "op7_hierarchical_mix": MIX,
    "op8_exact_dedup": EXACT,
    "op9_revisit_asof": REVISITS,
    "op12_prefix_trie": TRIE,
}
