"""DuckDB SQL for the queries of ``contract`` that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
        FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM hit, unnest(range(i, i + 13)) AS t(p)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP3 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
        FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
        FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, pat.n, item FROM win JOIN pat ON win.n = pat.n AND win.s = pat.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Records are made of pages as in ``warc.records_of_pages``, then each revisit takes the latest response before it.
OP4 = r"""
WITH p AS (SELECT page_id AS n, coalesce(html, '') AS html,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?://)', '') AS bare FROM pages),
c AS (SELECT n, html, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS q FROM p),
k AS (SELECT n, html, stem || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canon,
  '"' || md5(html) || '"' AS etag, 'day ' || CAST(n % 365 AS VARCHAR) AS changed FROM c),
v AS (SELECT n * 2 + 1 AS record_id, n, canon, n * 4 + CASE WHEN n % 3 = 0 THEN -1 ELSE 1 END AS ts,
  CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN '"' || CAST(n AS VARCHAR) || '"' ELSE etag END AS mine,
  CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN '"' || CAST(n AS VARCHAR) || '"' ELSE 'W/' || etag END AS shown,
  CASE WHEN n % 11 <> 0 AND n % 7 = 0 THEN changed END AS since FROM k),
a AS (SELECT v.*, (SELECT max(k.n) FROM k WHERE k.canon = v.canon AND k.n * 4 < v.ts) AS m FROM v),
r AS (SELECT a.*, k.etag AS had, k.changed AS stood, sha256(k.html) AS digest,
  CASE WHEN a.m IS NULL THEN 'orphan' WHEN mine IS NOT NULL THEN CASE WHEN mine = k.etag THEN 'resolved' ELSE 'mismatch' END
       WHEN since IS NOT NULL THEN CASE WHEN since = k.changed THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome
  FROM a LEFT JOIN k ON k.n = a.m)
SELECT record_id, canon AS url, ts, coalesce(m * 2, -1) AS response_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unverified')
    THEN concat_ws(chr(10), 'content-type: text/html', 'date: ' || CAST(n + 1 AS VARCHAR), 'etag: ' || coalesce(shown, had), 'expires: later', 'last-modified: ' || stood)
    ELSE concat_ws(chr(10), 'content-type: ignored', 'date: ' || CAST(n + 1 AS VARCHAR), 'etag: ' || shown, 'expires: later', 'last-modified: ' || since) END AS headers,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN digest END AS digest
FROM r
"""

#: Shares by weight, capped at three times the size: the level where the capped sources' sum and the others' weights meet.
OP9 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap,
      CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1) AS DOUBLE) AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source AS s, source_size, least(cap, weight * coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE weight * level <= cap), 0)) AS target FROM l),
r AS (SELECT doc_id, source, size, source_size, target,
      CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS ratio,
      (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || CAST(size AS VARCHAR) || ':mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.s),
q AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, ratio - floor(ratio) AS share, target - CAST(floor(ratio) AS BIGINT) * source_size AS rest, CAST(len(bin(size)) AS BIGINT) AS k FROM r),
k AS (SELECT source, k, any_value(rest) AS rest, CAST(sum(size) AS BIGINT) AS in_class FROM q WHERE share > 0 GROUP BY source, k),
v AS (SELECT *, (rest - CAST(coalesce(sum(in_class) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
      / CAST(nullif(sum(k * in_class) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS level FROM k),
i AS (SELECT source AS s, arg_max(level, k) AS level FROM v WHERE level * k <= 1 GROUP BY source),
n AS (SELECT q.*, least(1.0::DOUBLE, k * level) AS inclusion FROM q JOIN i ON q.source IS NOT DISTINCT FROM i.s WHERE share > 0),
p AS (SELECT *, (u / (1 - u)) * ((1 - inclusion) / inclusion) AS q FROM n),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p),
extra AS (SELECT doc_id, size FROM c WHERE upto <= rest OR (upto - size < rest AND upto - rest <= size / 2))
SELECT q.doc_id, q.size, source_size, target, (whole + CASE WHEN extra.doc_id IS NULL THEN 0 ELSE 1 END) * q.size AS taken
FROM q LEFT JOIN extra ON q.doc_id = extra.doc_id AND q.size = extra.size
"""

SQL: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op3_benchmark_decontamination": OP3,
    "op4_warc_revisits": OP4,
    "op9_pareto_mixing": OP9}
