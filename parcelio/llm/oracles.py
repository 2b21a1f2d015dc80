"""SQL equivalents of this folder's queries, where SQL can express them."""

from __future__ import annotations

from parcelio.llm.licenses import PHRASES, TEMPLATES

ORACLES: dict[str, str] = {}

ORACLES["op9_source_mixing"] = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS name
  FROM documents),
sizes AS (SELECT k, min(source) AS source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY k),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sizes),
weighed AS (
  SELECT k, source, source_size, source_size * 3 AS cap,
    ([5, 2, 1])[1 + place % 3]::BIGINT AS weight, ([-0.5, 0.0, 0.5])[1 + place % 3]::DOUBLE AS ramp
  FROM placed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT *, coalesce(weight * first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS) OVER (
    ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), cap::DOUBLE) AS target
  FROM levels),
strung AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.ramp,
    coalesce(sum(r.size) OVER (PARTITION BY r.k ORDER BY r.name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM rows_ r JOIN targets t USING (k)),
copies AS (
  SELECT *, CASE WHEN 2 * ahead + size <= 2 * floor(target) THEN size ELSE 0 END AS w0,
    CASE WHEN 2 * (ahead + source_size) + size <= 2 * floor(target) THEN size ELSE 0 END AS w1,
    CASE WHEN 2 * (ahead + 2 * source_size) + size <= 2 * floor(target) THEN size ELSE 0 END AS w2
  FROM strung),
timed AS (SELECT *, (ahead + w0 / 2.0::DOUBLE) / target AS x, 1 - ramp AS a FROM copies)
SELECT doc_id, size, source_size, target, (w0 + w1 + w2)::BIGINT AS taken,
  CASE WHEN w0 > 0 THEN round(2 * x / (a + sqrt(a * a + 4 * ramp * x)), 6) END AS first_position
FROM timed
"""

ORACLES["op1_warc_revisit_resolution"] = r"""
WITH base AS (
  SELECT page_id AS page, url, md5(coalesce(html, '')) AS digest, page_id % 6 AS turn FROM pages),
records AS (
  SELECT page * 2 AS record_id, false AS revisit, url, page * 60 AS ts, turn, digest,
    '"' || substr(digest, 1, 16) || '"' AS etag, 't' || (page * 60) AS lm, 't' || (page * 60) AS dt
  FROM base
  UNION ALL
  SELECT page * 2 + 1, true, url || CASE WHEN turn % 2 = 0 THEN '#again' ELSE '' END, page * 60 + 86400 * (1 + page % 7), turn,
    CASE WHEN turn = 4 THEN digest END,
    CASE turn WHEN 0 THEN '"' || substr(digest, 1, 16) || '"' WHEN 1 THEN 'W/"' || substr(digest, 1, 16) || '"' WHEN 3 THEN '"changed"' END,
    CASE WHEN turn = 2 THEN 't' || (page * 60) END,
    't' || (page * 60 + 86400 * (1 + page % 7))
  FROM base),
plain AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM records),
split AS (
  SELECT *,
    regexp_extract(u, '^[Hh][Tt][Tt][Pp][Ss]?://([^/?:]+)(?::[0-9]*)?([^?]*)\??(.*)$', 1) AS host,
    regexp_extract(u, '^[Hh][Tt][Tt][Pp][Ss]?://([^/?:]+)(?::[0-9]*)?([^?]*)\??(.*)$', 2) AS path,
    list_sort(list_filter(string_split(regexp_replace(regexp_extract(u, '^[Hh][Tt][Tt][Pp][Ss]?://([^/?:]+)(?::[0-9]*)?([^?]*)\??(.*)$', 3),
      '(^|&)(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)=[^&]*', '', 'gi'), '&'), lambda p: p <> '')) AS params
  FROM plain),
named AS (
  SELECT record_id, revisit, ts, etag, lm, dt, digest,
    regexp_replace(lower(host), '^www\.', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url
  FROM split),
hit AS (
  SELECT v.record_id, v.url, v.etag, v.lm, v.dt, v.digest, max({'ts': r.ts, 'id': r.record_id}) AS best
  FROM named v LEFT JOIN named r ON r.url = v.url AND NOT r.revisit AND r.ts < v.ts
  WHERE v.revisit GROUP BY ALL),
judged AS (
  SELECT h.*, r.record_id AS rid, r.etag AS retag, r.lm AS rlm, r.digest AS rdigest,
    coalesce(regexp_replace(h.etag, '^W/', '') = r.etag, h.lm = r.lm, h.digest = r.digest) AS same
  FROM hit h LEFT JOIN named r ON r.record_id = h.best.id),
outcomes AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN same IS NULL THEN 'unvalidated' WHEN same THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM judged)
SELECT record_id, url, outcome,
  CASE WHEN outcome = 'resolved' THEN rid END AS response_id,
  CASE WHEN outcome = 'resolved' THEN rdigest END AS digest,
  CASE WHEN outcome = 'resolved'
    THEN 'cache-control: max-age=60; content-type: text/html; date: ' || dt || '; etag: ' || coalesce(etag, retag) || '; last-modified: ' || coalesce(lm, rlm)
    ELSE 'content-length: 0; date: ' || dt || CASE WHEN etag IS NULL THEN '' ELSE '; etag: ' || etag END
      || CASE WHEN lm IS NULL THEN '' ELSE '; last-modified: ' || lm END END AS headers
FROM outcomes
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATE_ROWS = ", ".join(f"('{label}', '{text.lower()}')" for text, label in TEMPLATES)
_PHRASE_ROWS = ", ".join(f"('{label}', '{text}')" for text, label in PHRASES)

#: Every block against every template, without any filter.
ORACLES["op11_license_scan"] = f"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS words FROM documents),
docs AS (SELECT *, len(words) AS n FROM split),
phrases AS (SELECT label, string_split(text, ' ') AS w FROM (VALUES {_PHRASE_ROWS}) t(label, text)),
places AS (
  SELECT rid, label, unnest(list_filter(range(n), lambda i: words[i + 1:i + len(w)] = w)) AS place FROM docs, phrases),
base AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY rid),
templates AS (SELECT label, list_distinct({_WORDS.format("text")}) AS tokens FROM (VALUES {_TEMPLATE_ROWS}) t(label, text)),
starts AS (SELECT rid, words, unnest(range(greatest(ceil(n / 32)::BIGINT - 2, 0) + 1)) AS k FROM docs),
blocks AS (SELECT rid, list_distinct(words[32 * k + 1:32 * k + 64]) AS block FROM starts),
pairs AS (SELECT rid, label, len(tokens) AS size, len(list_intersect(block, tokens)) AS overlap FROM blocks, templates),
hits AS (
  SELECT rid, list(DISTINCT label) AS more, max(overlap / size) AS share FROM pairs WHERE 100 * overlap >= 80 * size GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  round(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END, 6) AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN hits USING (rid)
"""
