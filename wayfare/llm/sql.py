"""SQL for DuckDB that gives the same rows as the queries."""

from __future__ import annotations

_PLAIN = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, len, win FROM (
    SELECT item_id, len(w) AS len, array_to_string(w, ' ') AS win FROM b WHERE len(w) BETWEEN 1 AND 7
    UNION ALL
    SELECT item_id, 8 AS len, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8))),
lens AS (SELECT DISTINCT len FROM wins),
spots AS (
  SELECT rid, len, i, array_to_string(w[i:i + len - 1], ' ') AS win
  FROM (SELECT rid, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM d, lens WHERE len(w) >= len)),
hit AS (SELECT rid, i, spots.len, win FROM spots SEMI JOIN wins USING (win)),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + len)) AS p FROM hit) GROUP BY rid),
owners AS (
  SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit JOIN wins USING (win)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN owners USING (rid)"""

URL_FILTERS = """
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(regexp_replace(regexp_replace(string_split(host, '@')[-1], ':\\d*$', ''), '\\.+$', ''), '.') AS a
  FROM p LEFT JOIN known USING (page_id) GROUP BY host),
l AS (SELECT *, CASE WHEN array_to_string(a[greatest(len(a) - 1, 1):], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz', 'co.za', 'com.cn') THEN 2 ELSE 1 END AS k FROM h),
x AS (SELECT host, n, bad, array_to_string(a[greatest(len(a) - k + 1, 1):], '.') AS suffix, array_to_string(a[greatest(len(a) - k, 1):], '.') AS domain FROM l),
dx AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM x GROUP BY ALL),
sx AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dx GROUP BY ALL),
parts AS (
  SELECT 1 AS level, '' AS parent, n, bad FROM sx WHERE n > 0
  UNION ALL SELECT 2, suffix, n, bad FROM dx WHERE n > 0
  UNION ALL SELECT 3, suffix || ' ' || domain, n, bad FROM x WHERE n > 0),
means AS (SELECT *, sum(bad) OVER w / sum(n) OVER w AS m, sum(n) OVER w AS total FROM parts WINDOW w AS (PARTITION BY level, parent)),
groups AS (SELECT level, parent, any_value(m) * (1 - any_value(m)) AS v, sum(n * (bad / n - m) ^ 2) AS between_sum, count(*) - 1 AS free, any_value(total) - sum(n::DOUBLE * n) / any_value(total) AS pairs FROM means GROUP BY level, parent),
rho AS (SELECT level, CASE WHEN sum(v * (pairs - free)) > 1e-12 THEN sum(between_sum - v * free) / sum(v * (pairs - free)) END AS r FROM groups GROUP BY level),
weight AS (SELECT i AS level, CASE WHEN r IS NULL THEN 8.0 WHEN r <= 1 / 10001.0 THEN 10000.0 ELSE greatest(0.5, 1 / r - 1) END::DOUBLE AS s FROM range(1, 4) t(i) LEFT JOIN rho ON level = i),
whole AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS prior FROM x),
s AS (SELECT suffix, (bad + w.s * prior) / (n + w.s) AS sm FROM sx, whole, weight w WHERE level = 1),
d AS (SELECT suffix, domain, (bad + w.s * sm) / (n + w.s) AS dm FROM dx JOIN s USING (suffix), weight w WHERE level = 2),
r AS (SELECT host, bad + w.s * dm AS a, n - bad + w.s * (1 - dm) AS b FROM x JOIN d USING (suffix, domain), weight w WHERE level = 3),
-- the integral of the beta density up to 0.3, by Simpson's rule in steps of 0.3 / 20000 over a substitution that tames both ends
points AS (SELECT i, sin(i * asin(sqrt(0.3)) / 20000) ^ 2 AS t, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM range(0, 20001) p(i)),
below AS (
  SELECT host, sum(c * CASE WHEN t > 0 THEN 2 * exp((a - 0.5) * ln(t) + (b - 0.5) * ln(1 - t) + lgamma(a + b) - lgamma(a) - lgamma(b)) ELSE 0 END) * asin(sqrt(0.3)) / 60000 AS p
  FROM r, points WHERE a > 0.3 * (a + b) GROUP BY host),
rep AS (SELECT host, coalesce(p < 0.05, false) AS bad FROM r LEFT JOIN below USING (host)),
judged AS (
  SELECT page_id, host, path, rep.bad, CASE
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN ['example.com/en/7', 'allow']
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN ['example.net/de/8', 'block']
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN ['com/en/', 'block']
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN ['net/de/', 'allow']
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN ['org/es/', 'block'] END AS rule
  FROM p JOIN rep USING (host))
SELECT page_id, host, path, rule[1] AS rule, coalesce(rule[2], CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""

NEAR_DUPLICATES = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, doc_id, count(*) AS n FROM s GROUP BY rid, doc_id),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM pairs JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS rid, a AS other FROM both_ways UNION SELECT reach.rid, b FROM reach JOIN both_ways ON other = a),
comp AS (SELECT reach.rid, min(doc_id) AS component_id FROM reach JOIN n ON n.rid = reach.other GROUP BY reach.rid)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(component_id, d.doc_id), true) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN comp USING (rid)"""

LINE_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, source, text, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS a FROM d)),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS word FROM l),
wide AS (SELECT word FROM t WHERE word <> '' GROUP BY word HAVING count(DISTINCT source) >= 10),
first AS (SELECT word, min({'a': coalesce(doc_id, -9223372036854775808), 'b': pos}) AS first FROM t SEMI JOIN wide USING (word) GROUP BY word),
m AS (SELECT t.*, first IS NOT NULL AND first <> {'a': coalesce(doc_id, -9223372036854775808), 'b': pos} AS gone FROM t LEFT JOIN first ON first.word = t.word)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (word <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
  CASE WHEN any_value(text) IS NOT NULL THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) END AS text_sha256
FROM m GROUP BY rid"""

CHAT_FORMATTING = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, list('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) ORDER BY turn, role, text) AS x FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT x[1:i] AS x FROM (SELECT x, unnest(range(1, len(x))) AS i FROM c)),
w AS (SELECT x, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY x)
SELECT conv_id, len(x)::BIGINT AS n_turns, n_copies, sha256(array_to_string(x, '')) AS chat_sha256 FROM w ANTI JOIN p USING (x)"""

_ASSIGN = """(?i:(?:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = {
    "assign": _ASSIGN,
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "long": "[A-Za-z0-9+/_-]{32,}={0,2}",
    "short": "[A-Za-z0-9+/_-]{16,}={0,2}",
    "user": """(?i:\\b(?:user(?:_?name)?|login|account|client_?id)["']?\\x20*[:=]\\x20*["']?)[A-Za-z0-9@._-]{3,}""",
    "endpoint": """(?i:\\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://)[^ \\t\\n\\x0b\\f\\r"'<>]+""",
}
_QUOTED = {k: "'" + p.replace("'", "''") + "'" for k, p in _PATTERNS.items()}
_FOUND = " UNION ALL ".join(f"SELECT rid, '{k}' AS what, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits FROM d WHERE regexp_matches(t, {p})" for k, p in _QUOTED.items())

#: Every pair of parts of a text is looked at, without buckets.
SECRET_SCANS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
each AS (SELECT rid, what, i, len(gaps[i]) AS gap, hits[i] AS hit FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)),
placed AS (SELECT rid, what, hit, (sum(gap + len(hit)) OVER (PARTITION BY rid, what ORDER BY i))::BIGINT AS stop FROM each),
s AS (
  SELECT rid, what, stop - len(hit) AS start, stop FROM placed
  WHERE CASE what WHEN 'assign' THEN len(regexp_extract(hit, {_QUOTED['assign']}, 1)) >= 6
    WHEN 'long' THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')
    WHEN 'short' THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') ELSE true END),
base AS (SELECT * FROM s WHERE what IN ('assign', 'access', 'hex')),
free AS (SELECT * FROM s WHERE what IN ('long', 'short', 'user') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = s.rid AND b.start < s.stop AND s.start < b.stop) UNION ALL SELECT * FROM s WHERE what = 'endpoint'),
weak AS (SELECT * FROM free f WHERE what <> 'short' OR NOT EXISTS (SELECT 1 FROM free o WHERE o.rid = f.rid AND o.what <> 'short' AND o.start < f.stop AND f.start < o.stop)),
parts AS (
  SELECT *, CASE WHEN what IN ('assign', 'hex', 'long') THEN 'secret' WHEN what IN ('access', 'user') THEN 'id' WHEN what = 'short' THEN 'short' ELSE 'end' END AS role
  FROM (SELECT *, false AS alone FROM base UNION ALL SELECT *, true AS alone FROM weak)),
near AS (
  SELECT w.rid, w.what, w.start, w.stop, w.role, list(DISTINCT o.role) AS others FROM parts w JOIN parts o
    ON o.rid = w.rid AND o.role <> w.role AND o.stop >= w.start - 200 AND o.start <= w.stop + 200 WHERE w.alone GROUP BY ALL),
linked AS (
  SELECT rid, what, start, stop FROM near WHERE CASE role WHEN 'id' THEN list_has_any(others, ['secret', 'short']) WHEN 'secret' THEN list_has_any(others, ['id', 'end'])
    WHEN 'short' THEN list_contains(others, 'id') ELSE list_contains(others, 'secret') OR list_has_all(others, ['id', 'short']) END),
named AS (
  SELECT rid, what AS kind, start, stop, true AS plain FROM base
  UNION SELECT rid, CASE WHEN what IN ('long', 'short') THEN 'key' ELSE what END, start, stop, false FROM linked),
text AS (SELECT *, kind || ':' || start || ':' || stop AS said, list_position(['assign', 'access', 'hex', 'key', 'user', 'endpoint'], kind) AS n FROM named),
total AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(said, ',' ORDER BY start, n, stop) FILTER (plain), '')) AS base_sha256, string_agg(said, ',' ORDER BY start, n, stop) AS spans FROM text GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN total USING (rid)"""

SQL: dict[str, str] = {"op4_line_dedup": LINE_DEDUP, "op2_decontaminate": DECONTAMINATE, "op5_url_filters": URL_FILTERS, "op6_secret_scans": SECRET_SCANS, "op8_chat_formatting": CHAT_FORMATTING, "op9_near_duplicates": NEAR_DUPLICATES}
